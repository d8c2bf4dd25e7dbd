"""factloom: evidence-backed knowledge graphs and document analytics on Spark."""
