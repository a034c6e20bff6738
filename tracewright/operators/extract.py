"""Extraction from rendered batches: recorded answers, one re-read of what stayed silent, and replay of recorded responses."""

from __future__ import annotations

import bisect
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewright.operators.corpus import AUTOMATON_CHARS, batch_context, passes
from tracewright.storage import stash

#: What a batch that stayed silent is asked again with.
REREAD_NOTE = "\n\nNothing was found in these passages at first. Read them once more."
_MARK = re.compile(r"(?:\A|(?<=\n\n))\[P(\d+)\] \(")
ANSWERS = "array<struct<head: string, head_type: string, relation: string, tail: string, tail_type: string, label: int, quote: string>>"


def recorded_answers(rendered: DataFrame, quotes: DataFrame, keys: tuple[str, ...] = ("doc_id", "batch_no"), chars: int = AUTOMATON_CHARS) -> DataFrame:
    """The batch's ``keys``, ``item_id, label``: every recorded quote in every rendered batch that has it, with the first labelled passage that it stands in as a whole.

    ``rendered``: ``keys, rendered`` (see ``render_batches``); ``quotes``: ``item_id, quote``. One automaton of all quotes runs over each text once, whatever their number; where they have more than ``chars``
    characters, several do. Null and empty quotes are in nothing, repeated ones are found for each of their ids, a quote that runs over two passages in neither. ``REREAD_NOTE`` at the end of a
    text is part of no passage.
    """
    fields = {f.name: f.dataType.simpleString() for f in rendered.schema} | {f.name: f.dataType.simpleString() for f in quotes.schema}
    schema = ", ".join(f"{c} {fields[c]}" for c in (*keys, "item_id")) + ", label int"
    kinds = {f.name: to_arrow_type(f.dataType) for f in quotes.schema}
    spark, out = rendered.sparkSession, None
    rows = rendered.select(*keys, "rendered").filter("rendered IS NOT NULL")

    def scan(shared: object) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: dict[str, list] = {}
            for item, quote in shared.value:
                ids.setdefault(quote, []).append(item)
            seeker = ahocorasick.Automaton()
            for quote in ids:
                seeker.add_word(quote, quote)
            seeker.make_automaton()
            for batch in batches:
                at, items, labels = [], [], []
                for k, text in enumerate(batch.column(len(keys)).to_pylist()):
                    text = text.removesuffix(REREAD_NOTE)
                    marks = list(_MARK.finditer(text))
                    starts, first = [m.start() for m in marks], {}
                    for end, quote in seeker.iter(text):
                        own = bisect.bisect_right(starts, end - len(quote) + 1) - 1
                        if own >= 0 and (own + 1 == len(starts) or end < starts[own + 1]):
                            first.setdefault(quote, own)  # ends rise, and so do the passages of one quote
                    for quote, own in first.items():
                        for item in ids[quote]:
                            at.append(k)
                            items.append(item)
                            labels.append(int(marks[own].group(1)))
                columns = [batch.column(c).take(pa.array(at, pa.int64())) for c in range(len(keys))]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(items, kinds["item_id"]), pa.array(labels, pa.int32())], [*keys, "item_id", "label"])

        return found

    for some in passes(quotes.filter("quote <> ''").select("item_id", "quote"), chars):
        part = rows.mapInArrow(scan(spark.sparkContext.broadcast(some)), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def labels(blocks: DataFrame, batches: DataFrame) -> DataFrame:
    """``doc_id, batch_no, label, block_no``: which block each label of a batch stands for (see ``render_batches``)."""
    low, high = F.coalesce("before", "first_block"), F.coalesce("after", "last_block")
    places = batch_context(batches).withColumn("block_no", F.explode(F.sequence(low, high))).select("doc_id", "batch_no", "block_no")
    rows = places.join(blocks.select("doc_id", F.col("block_no").cast("bigint").alias("block_no")), ["doc_id", "block_no"])
    return rows.select("doc_id", "batch_no", F.row_number().over(Window.partitionBy("doc_id", "batch_no").orderBy("block_no")).alias("label"), "block_no")


def extract(prompts: DataFrame, extractor: Callable[[DataFrame], DataFrame], known: DataFrame, keys: tuple[str, ...] = ("doc_id", "batch_no")) -> tuple[DataFrame, DataFrame]:
    """Candidates and the coverage of batches, after one re-read of those that stayed silent.

    ``prompts``: the batch's ``keys, prompt``, each batch once. ``extractor`` takes such rows and returns ``keys, non_normative, answers`` (see ``ANSWERS``), any model or record behind it; a batch
    that it leaves out answered nothing. ``known``: ``keys, label, block_no``, the passages that may be cited. The first result has ``keys, label, block_no, reread`` and the answer's fields,
    and ``criterion``: ``citation`` for one that cites a passage which its batch doesn't have, else null. The second has
    ``keys, reread, non_normative, candidates, rejections, silent``. A batch is silent without a candidate that isn't said to be without norms; only such batches are read again, with a
    note, and then their second reading counts, beside the rejections of both.
    """
    on = list(keys)

    def read(rows: DataFrame, reread: bool) -> tuple[DataFrame, DataFrame]:
        said = stash(extractor(rows).select(*keys, F.coalesce("non_normative", F.lit(False)).alias("non_normative"), F.col("answers").cast(ANSWERS).alias("answers")), "answers")
        each = said.select(*keys, F.explode("answers").alias("a")).select(*keys, "a.*").join(known.select(*keys, "label", "block_no"), [*keys, "label"], "left")
        each = each.withColumns({"criterion": F.when(F.col("block_no").isNull(), "citation"), "reread": F.lit(reread)})
        counted = each.groupBy(*keys).agg(F.count("block_no").alias("candidates"), F.count("criterion").alias("rejections"))
        out = rows.select(*keys).join(said.drop("answers"), on, "left").join(counted, on, "left")
        number = {c: F.coalesce(c, F.lit(0)) for c in ("candidates", "rejections")}
        out = out.withColumns(number | {"non_normative": F.coalesce("non_normative", F.lit(False)), "reread": F.lit(reread)})
        return each, stash(out.withColumn("silent", (F.col("candidates") == 0) & ~F.col("non_normative")), "coverage")

    found, first = read(prompts, False)
    again = first.filter("silent")
    more, second = read(prompts.join(again.select(*keys), on, "left_semi").withColumn("prompt", F.concat("prompt", F.lit(REREAD_NOTE))), True)
    both = second.join(again.select(*keys, F.col("rejections").alias("_before")), on).withColumn("rejections", F.col("rejections") + F.col("_before")).drop("_before")
    return found.unionByName(more), first.filter("NOT silent").unionByName(both)


def request_key(system: Column, prompt: Column, schema: str, model: str, effort: str = "", max_tokens: int = 0) -> Column:
    """The SHA-256 of a request as JSON with sorted keys and without spaces. ``schema``: JSON written that way.

    Two requests share a response only if all of this is the same. Control characters other than the common escapes are written as Spark writes them.
    """
    text = lambda c: F.regexp_replace(F.regexp_replace(F.to_json(F.struct(c.alias("x"))), r'^\{"x":', ""), r"\}$", "")
    parts = [F.lit(f'{{"effort":"{effort}","max_tokens":{max_tokens},"model":"{model}","prompt":'), text(F.coalesce(prompt, F.lit(""))), F.lit(f',"schema":{schema},"system":'), text(F.coalesce(system, F.lit(""))), F.lit("}")]
    return F.sha2(F.concat(*parts), 256)


def record_responses(requests: DataFrame, name: str, path: str, buckets: int = 64) -> None:
    """Keep ``key, request, response`` as the table ``name``, its files below ``path``, in buckets by key; of a key's responses the first by text counts."""
    once = requests.groupBy("key").agg(F.min(F.struct("response", "request")).alias("v")).select("key", "v.request", "v.response")
    once.repartition(buckets, "key").write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").option("path", path).saveAsTable(name)


def replay(requests: DataFrame, name: str) -> DataFrame:
    """Requests (with ``key``) and their recorded ``response``; one that was never recorded is an error of the job, ``CACHE_MISS`` and the key's beginning.

    A miss must not pass for an empty answer: a build from other answers would be another build. Requests in a table bucketed like the record's are joined where they lie.
    """
    kept = requests.sparkSession.table(name).select("key", "response")
    miss = F.raise_error(F.concat(F.lit("CACHE_MISS: no recorded response for request "), F.left("key", F.lit(12)))).cast("string")
    return requests.join(kept, "key", "left").withColumn("response", F.coalesce("response", miss))
