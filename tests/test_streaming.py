from factloom.sources.folder_events import FolderEvents
from factloom.streaming import answers, jobs


def source(spark, path, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).parquet(path)


def test_ingest_drops_known_contents(spark, tmp_path):
    schema, path = "doc_id long, text string", str(tmp_path / "in")
    got = []
    write = lambda batch, n: got.extend(r.doc_id for r in batch.collect())
    stream = source(spark, path, [(1, "same text"), (2, "other")], schema)
    jobs.ingest(stream, write, str(tmp_path / "state")).awaitTermination()
    source(spark, path, [(3, "same text  "), (4, "new")], schema)
    jobs.ingest(stream, write, str(tmp_path / "state")).awaitTermination()
    assert sorted(got) == [1, 2, 4]


def test_subscriptions_see_each_batch(spark, tmp_path):
    got = []
    stream = source(spark, str(tmp_path / "in"), [(1, "ore"), (2, "slag")], "doc_id long, text string")
    jobs.subscriptions(stream, {"ore": lambda d: d.where("text = 'ore'")}, lambda name, hits, n: got.extend((name, r.doc_id) for r in hits.collect()), str(tmp_path / "state")).awaitTermination()
    assert got == [("ore", 1)]


def cached(spark, tmp_path, stream, seconds):
    out = str(tmp_path / "out")
    jobs.ttl_cache(stream, seconds, "0 seconds").writeStream.format("parquet").option("path", out).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    return {r.seq: r.replaced for r in spark.read.parquet(out).collect()}


def test_cache_entries_end(spark, tmp_path):
    from datetime import datetime, timedelta

    start, schema, path = datetime(2024, 1, 1), "seq long, key string, value string, at timestamp", str(tmp_path / "in")
    at = lambda s: start + timedelta(seconds=s)
    stream = source(spark, path, [(2, "a", "y", at(30)), (1, "a", "x", at(0)), (3, "b", "z", at(40)), (4, "a", "w", at(100))], schema)
    assert cached(spark, tmp_path, stream, 60) == {1: None, 2: "x", 3: None, 4: None}
    # What the first run put is still held by the second one, until it ends.
    source(spark, path, [(5, "a", "v", at(159)), (6, "b", "u", at(160)), (7, "a", None, at(170)), (8, "a", "t", at(171))], schema)
    assert cached(spark, tmp_path, stream, 60) == {1: None, 2: "x", 3: None, 4: None, 5: "w", 6: None, 7: "v", 8: None}


def test_puts_of_one_millisecond_keep_their_order(spark, tmp_path):
    from datetime import datetime, timedelta

    at = lambda us: datetime(2024, 1, 1) + timedelta(microseconds=us)
    rows = [(1, "a", "later", at(900)), (2, "a", "sooner", at(100)), (3, "a", "at its end", at(60_000_900)), (4, "b", "x", at(0)), (5, "b", "y", at(59_999_999)), (6, "b", "z", at(120_000_000))]
    stream = source(spark, str(tmp_path / "in"), rows, "seq long, key string, value string, at timestamp")
    assert cached(spark, tmp_path, stream, 60) == {2: None, 1: "sooner", 3: None, 4: None, 5: "x", 6: None}
    stream = source(spark, str(tmp_path / "in2"), [(1, "a", "x", at(500)), (2, "a", "y", at(60_000_499))], "seq long, key string, value string, at timestamp")
    out = tmp_path / "second"
    out.mkdir()
    assert cached(spark, out, stream, 60) == {1: None, 2: "x"}


def run_stream(df, out, state):
    df.writeStream.format("parquet").option("path", out).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def test_deltas_are_gathered_and_end_by_time(spark, tmp_path):
    from datetime import datetime, timedelta

    start, path = datetime(2024, 1, 1), str(tmp_path / "in")
    at = lambda s: start + timedelta(seconds=s)
    schema = "answer_id string, seq long, delta string, done boolean, at timestamp"
    long = [("a", k, f"word{k} ", False, at(k)) for k in range(40)]
    stream = source(spark, path, [*reversed(long), ("b", 0, "short", False, at(5)), ("b", 1, " one\nnew", None, at(6)), ("c", 0, None, True, at(1)), ("d", 0, "ends here", True, at(2))], schema)
    gathered = answers.buffered(stream, "0 seconds", 60)
    run_stream(gathered, str(tmp_path / "out"), str(tmp_path / "state"))

    def texts():
        rows = spark.read.parquet(str(tmp_path / "out")).orderBy("answer_id", "piece").collect()
        return {key: [r.text for r in rows if r.answer_id == key] for key in {r.answer_id for r in rows}}

    got = texts()
    whole = "".join(x[2] for x in long)
    assert got["d"] == ["ends here"] and "c" not in got and got["b"] == ["short one\nnew"]
    assert whole.startswith("".join(got["a"])) and all(40 <= len(x) < 48 for x in got["a"]) and len(whole) - len("".join(got["a"])) < 40
    # Later ones go on where the first run stopped; an answer without news ends by the others' time.
    source(spark, path, [("b", 2, " line", False, at(60)), ("e", 0, "other", False, at(400))], schema)
    run_stream(gathered, str(tmp_path / "out"), str(tmp_path / "state"))
    source(spark, path, [("e", 1, " again", True, at(900))], schema)
    run_stream(gathered, str(tmp_path / "out"), str(tmp_path / "state"))
    got = texts()
    assert "".join(got["a"]) == whole and "".join(got["b"]) == "short one\nnew line" and got["e"] == ["other again"]


def test_word_pieces_join_to_the_text(spark):
    texts = ["", "short", "x" * 200, "word " * 50, "a" * 59 + " b", "a" * 60 + " b", "line one\n\n| a | b |\n" * 20, "x" * 70 + "\tend of it", "ü" * 61 + "\n"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", answers.word_pieces("t").alias("p"))
    for r in df.collect():
        assert "".join(r.p) == r.t and all(len(x) >= 60 for x in r.p[:-1])
        assert all(x[-1] in " \n" or y[0].isspace() for x, y in zip(r.p, r.p[1:], strict=False))


STEPS = {answers.START: ("plan",), "plan": ("tool", "token"), "tool": ("tool", "token"), "token": ("token", "done", "error")}


def brute_offences(rows):
    out, last = {}, {}
    for key, seq, kind in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        before = last.get(key, answers.START)
        if key not in out and kind not in STEPS.get(before, ()):
            out[key] = (seq, before or None, kind)
        last[key] = kind
    return out


def test_first_offence_of_each_key(spark, tmp_path):
    import random

    rng = random.Random(5)
    rows = [(f"k{k}", s, rng.choices(["plan", "tool", "token", "done", "error"], [1 if s else 50, 3, 30, 1, 1])[0]) for k in range(60) for s in range(rng.randint(1, 9))]
    rows += [("hot", 0, "plan")] + [("hot", s, "token") for s in range(1, 4000)] + [("hot", 4000, "done"), ("hot", 4001, "token")] + [("fine", 0, "plan"), ("fine", 1, "token"), ("fine", 2, "done")]
    df = spark.createDataFrame(rows, "key string, seq long, kind string").repartition(7)
    want = brute_offences(rows)
    assert want["hot"] == (4001, "done", "token") and "fine" not in want
    assert {r.key: (r.seq, r.before, r.kind) for r in answers.first_offences(df, STEPS).collect()} == want
    path = str(tmp_path / "in")
    out, state = str(tmp_path / "out"), str(tmp_path / "state")
    stream = source(spark, path, [r for r in rows if r[1] < 3], "key string, seq long, kind string")
    run_stream(answers.offences(stream, STEPS), out, state)
    source(spark, path, [r for r in rows if r[1] >= 3], "key string, seq long, kind string")
    run_stream(answers.offences(stream, STEPS), out, state)
    assert {r.key: (r.seq, r.before, r.kind) for r in spark.read.parquet(out).collect()} == want


def test_folder_events_go_on_from_the_last_snapshot(spark, tmp_path):
    folder, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    (folder / "below").mkdir(parents=True)
    spark.dataSource.register(FolderEvents)
    stream = lambda: spark.readStream.format("folder_events").option("path", str(folder)).load()
    batches = []

    def run():
        query = stream().writeStream.foreachBatch(lambda df, n: batches.append(sorted(tuple(r) for r in df.collect()))).option("checkpointLocation", state)
        query.trigger(availableNow=True).start().awaitTermination()
        return [x for x in batches if x]

    (folder / "a.md").write_text("one")
    (folder / "below" / "b.txt").write_text("four")
    (folder / "~$a.md").write_text("x")
    (folder / ".hidden").write_text("x")
    assert run() == [[("a.md", "created", 3), ("below/b.txt", "created", 4)]]
    (folder / "a.md").write_text("one more")
    (folder / "below" / "b.txt").unlink()
    (folder / "c.md").write_text("")
    assert run()[1:] == [[("a.md", "modified", 8), ("below/b.txt", "deleted", None), ("c.md", "created", 0)]]
    # Nothing happened: nothing comes, also after a restart.
    assert len(run()) == 2
    (folder / "c.md").unlink()
    assert run()[2:] == [[("c.md", "deleted", None)]]


def test_folder_events_feed_the_ingest(spark, tmp_path):
    folder = tmp_path / "in"
    folder.mkdir()
    spark.dataSource.register(FolderEvents)
    got = []

    def read_new(df, n):
        names = [str(folder / r.path) for r in df.where("kind <> 'deleted'").collect()]
        if names:
            fresh = jobs.fresh_documents(spark.read.text(names, wholetext=True).withColumnRenamed("value", "text"))
            got.append(sorted(r.text for r in fresh.collect()))

    for texts in ({"a": "x", "b": "x"}, {"b": "y"}):
        for name, text in texts.items():
            (folder / f"{name}.txt").write_text(text)
        spark.readStream.format("folder_events").option("path", str(folder)).load().writeStream.foreachBatch(read_new).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    assert got == [["x"], ["y"]]
