"""The fold and the bursts: batch, stream and a plain loop agree, however the rows are cut into batches."""

import random
from datetime import timedelta

import pytest
from pyspark.sql import functions as F

from tests.core.test_operators import T0
from tmspark.operators import memory, progress
from tmspark.streaming import stateful

SAVES = "seq long, at timestamp, event string, project_id int, page_id long, bubble_id string, source_text string, ai_translation string, final_translation string, approve boolean"


def random_saves(seed, n=160):
    rng, rows = random.Random(seed), []
    for seq in range(1, n + 1):
        source = rng.choice(["WHERE ARE WE NOW", "Wait!", "wait...", "?!", "A LONGER LINE HERE"])
        final = rng.choice(["gdzie my teraz", "gdzie my teraz wlasciwie", "GDZIE MY TERAZ", "to jest szkic", "", "co", "czekaj no tu"])
        page = rng.choice([1, 1, 1, 2, None])
        rows.append((seq, T0 + timedelta(seconds=seq), rng.choice(["save"] * 7 + ["use"]), 1, page, rng.choice(["b1", "b2", "b3", ""]), source, "to jest szkic", final, bool(seq % 2)))
    return rows


def chains():
    """Three bubbles each add an entry, then each goes back to the draft: every removal opens the entry before it."""
    rows, say = [], ["ala ma kota", "ola ma psa", "ela ma rybe"]
    for n in range(3):
        rows.append(("save", f"b{n}", say[n]))
    for n in (2, 1):
        rows.append(("save", f"b{n}", "to jest szkic"))
    rows += [("save", "b0", "ala ma koty dwa"), ("use", None, None), ("save", "b0", "to jest szkic")]
    return [(k + 1, T0 + timedelta(seconds=k), e, 1, 7, b, "SHE HAS A PET", "to jest szkic", f, False) for k, (e, b, f) in enumerate(rows)]


def plain(rows):
    """The reference's save rules by a loop over whole histories."""
    entries = {}
    for seq, _, event, project, page, bubble, source, draft, final, _ in rows:
        key = " ".join("".join(c for c in source.lower() if c.isalnum() or c in "_ ").split())
        history = entries.setdefault((project, key), [])
        if event == "use":
            if history:
                history[-1][3] += 1
            continue
        text, storable = (final or "").strip(), True
        if text.lower() == draft.lower() or not text:
            storable = False
        if text and len(source.split()) <= 2:
            if not key:
                continue
        elif text and len(text.split()) < 3:
            storable = False
        if history and history[-1][1].lower() == text.lower():
            continue
        own = bool(history) and page is not None and bool(bubble) and history[-1][2] == (page, bubble) and not history[-1][3]
        if storable and own:
            history[-1][1] = text
        elif storable:
            history.append([seq, text, (page, bubble), 0])
        elif own:
            history.pop()
    return sorted((e[0], e[1], e[3]) for rows_ in entries.values() for e in rows_)


@pytest.mark.parametrize("batch", [1, 2, 7, 10_000])
def test_fold_is_the_same_for_any_batch_size(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        for rows in (chains(), random_saves(1), random_saves(2)):
            got = memory.fold_corrections(spark.createDataFrame(rows, SAVES)).collect()
            assert sorted((r.id, r.final_translation, r.reuse_count) for r in got) == plain(rows)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def run_stream(spark, path, frame, cuts, transform, mode):
    """The batches' outputs of a stream that is stopped and started again after each cut of the rows."""
    stateful.use_state_store(spark)
    outs = []
    for n, (low, high) in enumerate(cuts):
        frame.where(F.col("seq").between(low, high)).coalesce(1).write.mode("append").parquet(f"{path}/in")
        stream = spark.readStream.schema(frame.schema).parquet(f"{path}/in")
        put = lambda df, b, n=n: outs.append((n, b, df.collect()))
        writer = transform(stream).writeStream.outputMode(mode).foreachBatch(put)
        writer.option("checkpointLocation", f"{path}/cp").trigger(availableNow=True).start().awaitTermination()
    return [row for _, _, rows in sorted(outs, key=lambda x: x[:2]) for row in rows]


@pytest.mark.parametrize("step", [3, 60])
def test_changes_of_the_stream_give_the_batch(spark, tmp_path, step):
    rows = chains() if step == 3 else random_saves(3)
    frame = spark.createDataFrame(rows, SAVES)
    cuts = [(k, k + step - 1) for k in range(1, len(rows) + 1, step)]
    now, written = {}, 0
    for change in run_stream(spark, tmp_path, frame, cuts, stateful.fold_changes, "update"):
        written += 1
        if change.change == "remove":
            del now[change.id]
        else:
            now[change.id] = (change.id, change.final_translation, change.reuse_count)
    assert sorted(now.values()) == plain(rows)
    assert written <= len(rows)


def test_bursts_equal_the_batch_operator(spark, tmp_path):
    rng, rows = random.Random(4), []
    at = T0
    for seq in range(90):
        at += timedelta(seconds=rng.choice([0, 1, 20, 60, 61, 90]))
        rows.append((rng.choice([1, 2]), seq, rng.choice(["layout", "layout", "layout", "layout_bulk", "merge"]), rng.choice(["b1", "b2", None]), rng.choice(["d", None]), at))
    last = [(page, 90 + page, "end", None, None, at + timedelta(days=1)) for page in (1, 2)]
    schema = "page_id long, seq int, op string, bubble string, detail string, at timestamp"
    frame = spark.createDataFrame(rows + last, schema)
    cuts = [(0, 30), (31, 75), (76, 89), (90, 99)]
    got = run_stream(spark, tmp_path, frame, cuts, lambda s: stateful.layout_bursts(s, watermark="1 minute"), "append")
    want = progress.coalesce_ops(spark.createDataFrame(rows, schema)).collect()
    shown = lambda rows_: sorted((r.page_id, r.seq, r.op, r.bubble or "", r.at, r.last_at, r.n) for r in rows_ if r.op != "end")
    assert shown(got) == shown(want)


def test_enriched_stream_killed_and_started_again_equals_the_batch(spark, tmp_path):
    import shutil

    from tmspark.streaming import jobs

    rng = random.Random(6)
    unit = lambda: [x / 4 for x in rng.choices([-2.0, 2.0], k=4)]  # noqa: E731  of length 1
    texts = ["WHERE ARE WE NOW", "THE WYVERN IS HERE", "wait", "A LONGER LINE OF TEXT"]
    bubbles = spark.createDataFrame([(k, 1 + k % 2, rng.choice(texts), unit()) for k in range(40)], "query_id long, project_id int, text string, embedding array<double>")
    held = spark.createDataFrame([(k, 1 + k % 2, f"line number {k} is here" if k else "Wait!", f"tekst {k}", "corrected", unit()) for k in range(30)], "id long, project_id int, source_text string, final_translation string, kind string, embedding array<double>")
    terms = spark.createDataFrame([(1, 1, "WYVERN", "wywern")], "id int, project_id int, source_term string, target_term string")
    settings = {"threshold": 0.4, "lexical_min": 0}

    def start(batch):
        bubbles.where(F.col("query_id") % 3 == batch).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        go()

    def go():
        stream = spark.readStream.schema(bubbles.schema).parquet(f"{tmp_path}/in")
        jobs.enrich_batches(stream, held, terms, f"{tmp_path}/out", f"{tmp_path}/cp", **settings).trigger(availableNow=True).start().awaitTermination()

    start(0)
    start(1)
    shutil.rmtree(f"{tmp_path}/cp/commits")  # as if it was killed after writing its last batch and before saying so
    shutil.copytree(f"{tmp_path}/cp", f"{tmp_path}/before")
    go()
    start(2)
    got = {r.query_id: r for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert spark.read.parquet(f"{tmp_path}/out").count() == len(got) == 40
    plain_ = {r.query_id: [t.source_term for t in r.terms] for r in jobs.enrich(bubbles, held, terms).select("query_id", "terms").collect()}
    exact = {r.query_id: r.correction_id for r in jobs.enrich(bubbles, held).collect()}
    best = {}
    for r in memory.tm_fuzzy(bubbles, held, **settings).orderBy("rank").collect():
        best.setdefault(r.query_id, []).append((r.rank, r.correction_id))
    assert best and any(k is not None for k in exact.values())
    for k, r in got.items():
        assert [(e.rank, e.correction_id) for e in r.examples or []] == best.get(k, [])
        assert r.correction_id == exact[k] and [t.source_term for t in r.terms] == plain_[k]


def test_limits_in_the_stream_equal_the_batch(spark, tmp_path):
    from tmspark.operators import logs

    rng, rows, at = random.Random(21), [], T0
    for seq in range(150):
        at += timedelta(minutes=rng.choice([1, 30, 200]))
        kind = rng.choice(["success"] * 5 + ["limit", "server_counts"])
        number = rng.choice([None, None, 0, 5, 50]) if kind != "success" else None
        rows.append((seq, rng.choice(["gemini", "other"]), rng.choice(["k1", "k2"]), "m", kind, rng.random() < 0.4, number, rng.choice([None, 3]) if kind == "server_counts" else None, at))
    schema = "seq long, provider string, key_id string, model string, kind string, daily boolean, limit_value int, left_value int, at timestamp"
    frame = spark.createDataFrame(rows, schema)
    got = {}
    for r in run_stream(spark, tmp_path, frame, [(0, 20), (21, 90), (91, 149)], stateful.key_limits, "update"):
        got[r.provider, r.key_id] = r
    assert len(got) == 4
    for (provider, key), r in got.items():
        own = frame.where((F.col("provider") == provider) & (F.col("key_id") == key))
        want = logs.key_usage(own, r.at).first()
        assert (r.today, r.limit_day, r.limit_source, r.limit_minute, r.left, r.exhausted) == (want.today, want.limit_day, want.limit_source, want.limit_minute, want.left, want.exhausted)
