from factloom.operators import graph


def test_near_experiments(spark):
    nodes = spark.createDataFrame([("e1", "Experiment", "first"), ("e2", "Experiment", None), ("e3", "Experiment", "far"), ("e4", "Experiment", "gone"), ("m", "Material", "ore"), ("p", "Parameter", "heat")], "node_key string, label string, name string")
    rows = [("e1", "m", "USES_MATERIAL", False, None, None), ("e1", "p", "HAS_CONDITION", None, 1.0, 2.0), ("e1", "p", "HAS_CONDITION", True, 9.0, 9.0), ("m", "e2", "STUDIES", False, None, None), ("e3", "p", "HAS_CONDITION", False, 3.0, 3.0), ("e4", "m", "USES_MATERIAL", True, None, None)]
    edges = spark.createDataFrame([(*r, None, None) for r in rows], "src_key string, dst_key string, rel_type string, deleted boolean, value_min double, value_max double, unit_canon string, value_text string")
    starts = spark.createDataFrame([("m",)], "node_key string")
    got = {r.experiment: (r.name, [(c.rel_type, c.target, c.value_min) for c in r.conditions]) for r in graph.near_experiments(nodes, edges, starts).collect()}
    assert got == {"e1": ("first", [("HAS_CONDITION", "heat", 1.0), ("USES_MATERIAL", "ore", None)]), "e2": ("e2", [])}
    assert [r.experiment for r in graph.near_experiments(nodes, edges, starts, 1).collect()] == ["e1"]
