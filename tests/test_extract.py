"""Recorded answers, extraction with a re-read, and replay, on small tables."""

import random

import pytest
from pyspark.sql import functions as F

from tracewright.operators import extract


def test_recorded_answers_are_those_of_a_naive_search(spark):
    rng = random.Random(4)
    draw = lambda n: "".join(rng.choice("ab é\n") for _ in range(n)).replace("\n\n", "\n ")
    batches = [(k, 0, [draw(rng.randint(0, 40)) for _ in range(rng.randint(1, 5))]) for k in range(30)] + [(99, 0, ["said [P2] (x)", "b"]), (100, 1, None)]
    rendered = [(d, b, parts and "\n\n".join(f"[P{k}] (line {k})\n{p}" for k, p in enumerate(parts, 1))) for d, b, parts in batches]
    quotes = [(k, draw(rng.randint(1, 5))) for k in range(60)] + [(70, "a"), (71, "a"), (72, ""), (73, None), (74, "[P2]"), (75, "(line 1)")]
    want = set()
    for (d, b, parts), (_, _, text) in zip(batches, rendered, strict=True):
        for item, quote in quotes:
            for k, p in enumerate(parts or (), 1):
                ends = "\n\n" if k < len(parts) else ""
                if quote and quote in f"[P{k}] (line {k})\n{p}{ends}":
                    want.add((d, b, item, k))
                    break
    df = spark.createDataFrame(rendered, "doc_id long, batch_no long, rendered string").repartition(3)
    for chars in (extract.AUTOMATON_CHARS, 20):  # in one pass and in several
        got = {tuple(r) for r in extract.recorded_answers(df, spark.createDataFrame(quotes, "item_id int, quote string"), chars=chars).collect()}
        assert got == want
    assert extract.recorded_answers(df, spark.createDataFrame([], "item_id int, quote string")).count() == 0


def test_the_note_of_a_second_reading_is_no_passage(spark):
    texts = [(1, 0, "[P1] (line 0)\nnothing here" + extract.REREAD_NOTE), (2, 0, "[P1] (line 0)\nfirst\n\n[P2] (line 1)\nat last" + extract.REREAD_NOTE)]
    quotes = spark.createDataFrame([(1, "at"), (2, "e"), (3, "Read them")], "item_id int, quote string")
    found = extract.recorded_answers(spark.createDataFrame(texts, "doc_id long, batch_no long, rendered string"), quotes).collect()
    assert {tuple(r) for r in found} == {(1, 0, 2, 1), (2, 0, 1, 2), (2, 0, 2, 1)}


def test_silent_batches_are_read_once_more(spark):
    prompts = spark.createDataFrame([(k, 0, f"p{k}") for k in range(6)], "doc_id int, batch_no int, prompt string")
    known = spark.createDataFrame([(k, 0, 1, 10 + k) for k in range(6)], "doc_id int, batch_no int, label int, block_no int")
    answer = lambda label: ("h", "T", "R", "t", "U", label, "q")
    said = {0: (False, [answer(1), answer(5)]), 1: (True, []), 2: (False, [answer(2)]), 3: (None, None), 5: (False, [])}
    again = {2: (False, [answer(1), answer(3)]), 3: (False, None), 4: (True, []), 5: (False, [answer(1)])}
    asked = []

    def extractor(rows):
        asked.append({(r["doc_id"], r["prompt"].endswith(extract.REREAD_NOTE)) for r in rows.collect()})
        found = said if len(asked) == 1 else again
        kind = f"doc_id int, batch_no int, non_normative boolean, answers {extract.ANSWERS}"
        return spark.createDataFrame([(d, 0, *found[d]) for d, _ in sorted(asked[-1]) if d in found], kind)

    candidates, coverage = extract.extract(prompts, extractor, known)
    assert asked == [{(k, False) for k in range(6)}, {(k, True) for k in (2, 3, 4, 5)}]
    got = {r["doc_id"]: (r["reread"], r["non_normative"], r["candidates"], r["rejections"], r["silent"]) for r in coverage.collect()}
    assert got == {0: (False, False, 1, 1, False), 1: (False, True, 0, 0, False), 2: (True, False, 1, 2, False), 3: (True, False, 0, 0, True), 4: (True, True, 0, 0, False), 5: (True, False, 1, 0, False)}
    rows = sorted((r["doc_id"], r["label"], r["block_no"] or 0, r["criterion"] or "", r["reread"]) for r in candidates.collect())
    assert rows == [(0, 1, 10, "", False), (0, 5, 0, "citation", False), (2, 1, 12, "", True), (2, 2, 0, "citation", False), (2, 3, 0, "citation", True), (5, 1, 15, "", True)]


def test_replay_joins_where_the_records_lie_and_refuses_a_miss(spark, tmp_path):
    key = extract.request_key(F.lit("sys"), F.col("prompt"), '{"type":"object"}', "m-1")
    requests = spark.createDataFrame([(f"say \"{k}\" é/\n",) for k in range(40)], "prompt string").withColumn("key", key)
    import hashlib
    import json

    payload = {"model": "m-1", "effort": "", "max_tokens": 0, "system": "sys", "prompt": 'say "0" é/\n', "schema": {"type": "object"}}
    assert requests.first()["key"] == hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()).hexdigest()
    answered = requests.select("key", F.col("prompt").alias("request"), F.concat(F.lit("re "), "prompt").alias("response"))
    for name in ("recorded_responses", "asked"):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        extract.record_responses(answered.unionByName(answered.withColumn("response", F.lit("zz"))), "recorded_responses", str(tmp_path / "responses"), buckets=4)
        requests.repartition(4, "key").write.bucketBy(4, "key").sortBy("key").option("path", str(tmp_path / "asked")).saveAsTable("asked")
        found = extract.replay(spark.table("asked"), "recorded_responses")
        assert {r["response"] for r in found.collect()} == {f"re say \"{k}\" é/\n" for k in range(40)}
        assert "Exchange" not in found._jdf.queryExecution().executedPlan().toString()
        with pytest.raises(Exception, match="CACHE_MISS"):
            extract.replay(requests.withColumn("key", F.concat("key", F.lit("x"))), "recorded_responses").collect()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        for name in ("recorded_responses", "asked"):
            spark.sql(f"DROP TABLE IF EXISTS {name}")
