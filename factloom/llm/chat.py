"""Operator 5: preference formatting of chosen and rejected conversations.

Turns are compared position by position as rows: a position is shared if both
conversations hold the same roles and texts there. The prompt is what stands
before the first position that isn't shared. Prompt turns are emitted once for
the pair, all other turns as completions of their side. A completion is trained
on where its role is the trained one: loss_from and loss_to give that span of
the rendered turn, in code points; elsewhere both are 0. A pair of at most
PAIR_CHARS characters becomes one row with its prompt and its two masked
completions; of a larger one each turn stays a row, so it never has to fit into
one task, and its rows get its fork by broadcast.

Defined results: a null role or text counts as empty; a null turn stands after
all others and is never shared; repeated rows of a turn are compared as a
multiset and all are emitted; a side without rows leaves the other side's turns
as its completion; an empty table gives an empty result; other columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from factloom.llm.common import checkpoint, join_by_key

HEAD, MIDDLE, TAIL = "<|", "|>\n", "<|end|>\n"
TRAINED_ROLE = "assistant"
#: Characters of roles and texts of both sides up to which a pair is put together in one row.
PAIR_CHARS = 4_000_000


def _side(digest: Column, chosen: Column) -> Column:
    """A side's turns at one position, as a multiset."""
    own = F.when(chosen, digest)
    return F.struct(F.count(own).alias("n"), F.min(own), F.max(own), F.sum(F.when(chosen, F.xxhash64(digest).cast("decimal(38,0)"))))


def preference_rows(turns: DataFrame, trained_role: str = TRAINED_ROLE) -> DataFrame:
    """turns: pair_id, chosen (boolean), turn, role, text. Returns pair_id, part, turn, role, rendered, loss_from, loss_to and pair_chars."""
    rows = turns.select("pair_id", F.coalesce("chosen", F.lit(True)).alias("chosen"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    digest = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)
    places = rows.groupBy("pair_id", "turn").agg(_side(digest, F.col("chosen")).alias("a"), _side(digest, ~F.col("chosen")).alias("b"), F.sum(F.length("role") + F.length("text")).cast("long").alias("place_chars"))
    differs = F.col("turn").isNull() | ~F.col("a").eqNullSafe(F.col("b"))
    n_rows = F.sum(F.col("a")["n"] + F.col("b")["n"]).alias("n_rows")
    size = F.sum("place_chars").alias("pair_chars")
    forks = checkpoint(places.groupBy("pair_id").agg(F.min(F.when(differs, F.coalesce("turn", F.lit(2**62)))).alias("fork"), n_rows, size))
    placed = join_by_key(rows, forks, ["pair_id"], "n_rows")
    shared = F.coalesce("turn", F.lit(2**62)) < F.coalesce("fork", F.lit(2**62))
    part = F.when(shared, "prompt").when(F.col("chosen"), "chosen").otherwise("rejected")
    head = F.concat(F.lit(HEAD), "role", F.lit(MIDDLE))
    rendered = F.concat(head, "text", F.lit(TAIL))
    trained = ~shared & (F.col("role") == trained_role)
    return placed.where(~shared | F.col("chosen")).select(
        "pair_id", part.alias("part"), "turn", "role", rendered.alias("rendered"),
        F.when(trained, F.length(head)).otherwise(0).cast("long").alias("loss_from"), F.when(trained, F.length(rendered)).otherwise(0).cast("long").alias("loss_to"), "pair_chars",
    )


def neighbours_as_pairs(conversations: DataFrame) -> DataFrame:
    """Conversations 2k and 2k + 1 as the chosen and the rejected one of pair k, for a table without preferences."""
    return conversations.select(F.floor(F.col("conv_id") / 2).cast("long").alias("pair_id"), (F.pmod("conv_id", F.lit(2)) == 0).alias("chosen"), "turn", "role", "text")


def assemble(rows: DataFrame) -> DataFrame:
    """pair_id, prompt, chosen, rejected, chosen_loss, rejected_loss: a pair in one row, for pairs that a trainer can hold in memory.

    A completion's loss is an array of (loss_from, loss_to): the spans of that string, in code points, that are trained on.
    """
    held = rows.groupBy("pair_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("turn", F.lit(2**62)).alias("turn"), "role", "rendered", "part", "loss_from", "loss_to"))).alias("turns"))

    def turns_of(name: str) -> Column:
        return F.filter("turns", lambda x: x["part"] == name)

    def text(name: str) -> Column:
        return F.array_join(F.transform(turns_of(name), lambda x: x["rendered"]), "").alias(name)

    def loss(name: str) -> Column:
        # Each turn adds its length to the offset of those after it.
        start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<loss_from: bigint, loss_to: bigint>>").alias("spans"))

        def step(done: Column, x: Column) -> Column:
            span = F.array(F.struct((done["at"] + x["loss_from"]).alias("loss_from"), (done["at"] + x["loss_to"]).alias("loss_to")))
            return F.struct((done["at"] + F.length(x["rendered"])).alias("at"), F.when(x["loss_to"] > 0, F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

        return F.aggregate(turns_of(name), start, step, lambda done: done["spans"]).alias(f"{name}_loss")

    return held.select("pair_id", text("prompt"), text("chosen"), text("rejected"), loss("chosen"), loss("rejected"))


def _spans(loss: str) -> Column:
    return F.array_join(F.transform(loss, lambda x: F.concat(x["loss_from"].cast("string"), F.lit(":"), x["loss_to"].cast("string"))), ",").alias(loss)


def preference_pairs(turns: DataFrame, trained_role: str = TRAINED_ROLE, pair_chars: int = PAIR_CHARS) -> tuple[DataFrame, DataFrame]:
    """The pairs of turns as assemble gives them, and the turns of those pairs that are larger than pair_chars, as preference_rows gives them."""
    rows = checkpoint(preference_rows(turns, trained_role))
    return assemble(rows.where(F.col("pair_chars") <= pair_chars)), rows.where(F.col("pair_chars") > pair_chars).drop("pair_chars")


def preferences(turns: DataFrame, trained_role: str = TRAINED_ROLE, pair_chars: int = PAIR_CHARS) -> DataFrame:
    """Both tables as one: pair_id, prompt, chosen, rejected, chosen_loss, rejected_loss (spans start:end, comma-joined) of pairs; part, turn, role, rendered, loss_from, loss_to of turns of larger pairs."""
    pairs, large = preference_pairs(turns, trained_role, pair_chars)
    shown = pairs.select("pair_id", "prompt", "chosen", "rejected", _spans("chosen_loss"), _spans("rejected_loss"))
    return shown.unionByName(large, allowMissingColumns=True)


SQL = r"""
WITH rows AS (
  SELECT CAST(floor(conv_id / 2.0) AS BIGINT) AS pair_id, coalesce(conv_id % 2 = 0, true) AS chosen, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations),
places AS (
  SELECT pair_id, turn,
         list_sort(list(role || chr(0) || text) FILTER (WHERE chosen)) IS NOT DISTINCT FROM list_sort(list(role || chr(0) || text) FILTER (WHERE NOT chosen)) AS same
  FROM rows GROUP BY pair_id, turn),
forks AS (
  SELECT pair_id, min(CASE WHEN turn IS NULL OR NOT same THEN coalesce(turn, 4611686018427387904) END) AS fork FROM places GROUP BY pair_id),
placed AS (
  SELECT r.*, coalesce(r.turn, 4611686018427387904) < coalesce(f.fork, 4611686018427387904) AS shared
  FROM rows r JOIN forks f ON r.pair_id IS NOT DISTINCT FROM f.pair_id),
rendered AS (
  SELECT pair_id, CASE WHEN shared THEN 'prompt' WHEN chosen THEN 'chosen' ELSE 'rejected' END AS part, turn, role,
         '<|' || role || '|>' || chr(10) || text || '<|end|>' || chr(10) AS rendered, NOT shared AND role = 'assistant' AS trained,
         length(role) + 5 AS head
  FROM placed WHERE NOT shared OR chosen),
sizes AS (SELECT pair_id, sum(length(role) + length(text)) AS pair_chars FROM rows GROUP BY pair_id),
ordered AS (
  SELECT r.*, pair_chars, sum(length(rendered)) OVER (PARTITION BY r.pair_id, part ORDER BY coalesce(turn, 4611686018427387904), role, rendered ROWS UNBOUNDED PRECEDING) - length(rendered) AS begins
  FROM rendered r JOIN sizes s ON r.pair_id IS NOT DISTINCT FROM s.pair_id)
SELECT pair_id, coalesce(string_agg(rendered, '' ORDER BY coalesce(turn, 4611686018427387904), role, rendered) FILTER (WHERE part = 'prompt'), '') AS prompt,
       coalesce(string_agg(rendered, '' ORDER BY coalesce(turn, 4611686018427387904), role, rendered) FILTER (WHERE part = 'chosen'), '') AS chosen,
       coalesce(string_agg(rendered, '' ORDER BY coalesce(turn, 4611686018427387904), role, rendered) FILTER (WHERE part = 'rejected'), '') AS rejected,
       coalesce(string_agg((begins + head) || ':' || (begins + length(rendered)), ',' ORDER BY begins) FILTER (WHERE part = 'chosen' AND trained), '') AS chosen_loss,
       coalesce(string_agg((begins + head) || ':' || (begins + length(rendered)), ',' ORDER BY begins) FILTER (WHERE part = 'rejected' AND trained), '') AS rejected_loss,
       CAST(NULL AS VARCHAR) AS part, CAST(NULL AS BIGINT) AS turn, CAST(NULL AS VARCHAR) AS role, CAST(NULL AS VARCHAR) AS rendered, CAST(NULL AS BIGINT) AS loss_from, CAST(NULL AS BIGINT) AS loss_to
FROM ordered WHERE pair_chars <= 4000000 GROUP BY pair_id
UNION ALL
SELECT pair_id, NULL, NULL, NULL, NULL, NULL, part, turn, role, rendered, CASE WHEN trained THEN head ELSE 0 END, CASE WHEN trained THEN length(rendered) ELSE 0 END
FROM ordered WHERE pair_chars > 4000000
"""
