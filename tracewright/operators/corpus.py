"""Documents to blocks, passages and batches."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import ahocorasick
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tracewright.functions.text import NUMBER_WORDS, as_number, collapsed, digest, folded, source_span

#: Characters of the quotes that one automaton has, about 100 bytes each; more quotes are sought in several passes.
AUTOMATON_CHARS = 2_000_000
#: Where sentences end.
SENTENCE_END = r"(?<=[.!?])\s+(?=[A-Z])"
#: Phrases that introduce a limit, before its number and a unit of one to three words.
LIMIT = r"(?i)\b(maximum of|minimum of|no more than|no fewer than|at most|at least|up to|within)\s+(\d+|" + "|".join(NUMBER_WORDS) + r")\s+((?:[A-Za-z][A-Za-z-]*\s+){0,2}[A-Za-z][A-Za-z-]*)"
#: Modal verbs and how hard a rule with them bites, in the order in which they are tried.
MODALS = (
    (r"(?i)\b(must not|may not|shall not|cannot|do not|does not|never)\b", "error"),
    (r"(?i)\b(must|shall|is required to|are required to)\b", "error"),
    (r"(?i)\b(should not|ought not)\b", "warning"),
    (r"(?i)\b(should|ought to)\b", "warning"),
    (r"(?i)\b(may|can|is permitted to|are permitted to)\b", "info"),
)


def line_blocks(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, block_no, text``: a block for each line that isn't blank, trimmed; null texts give none."""
    lines = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(F.split(F.col(text), "\n")).alias("block_no", "line"))
    return lines.select("doc_id", "block_no", F.trim("line").alias("text")).filter("text <> ''")


def markup_blocks(pages: DataFrame, page_id: str = "page_id", html: str = "html") -> DataFrame:
    """``page_id, block_no, kind, text``: headings, list items and paragraphs in their order."""
    found = F.regexp_extract_all(F.col(html), F.lit(r"(?s)<(h1|li|p)\b[^>]*>(.*?)</(?:h1|li|p)>"), F.lit(0))
    rows = pages.select(F.col(page_id).alias("page_id"), F.posexplode(found).alias("block_no", "raw"))
    tag = F.regexp_extract("raw", r"^<(h1|li|p)", 1)
    kind = F.when(tag == "h1", "heading").when(tag == "li", "list").otherwise("paragraph")
    return rows.select("page_id", "block_no", kind.alias("kind"), collapsed(F.regexp_replace("raw", "<[^>]*>", " ")).alias("text")).filter("text <> ''")


def row_text(cells: list[tuple[str, Column]]) -> Column:
    """``label: value | …`` of a table row; blank cells are left out, unnamed ones go by their place."""
    parts = [F.when(F.trim(v.cast("string")) != "", F.concat(F.lit(f"{name or f'column {k}'}: "), F.trim(v.cast("string")))) for k, (name, v) in enumerate(cells, 1)]
    return F.concat_ws(" | ", *parts)


def find_furniture(blocks: DataFrame, min_repeats: int = 3, max_chars: int = 90) -> DataFrame:
    """``doc_id, text, n``: short blocks that a document repeats, such as running heads."""
    short = blocks.filter(F.length("text") <= max_chars)
    return short.groupBy("doc_id", "text").agg(F.count("*").alias("n")).filter(F.col("n") >= min_repeats)


def strip_furniture(blocks: DataFrame, furniture: DataFrame) -> DataFrame:
    """Blocks without the repeated ones."""
    return blocks.join(furniture.select("doc_id", "text"), ["doc_id", "text"], "left_anti")


def passages(blocks: DataFrame, location: Column) -> DataFrame:
    """``passage_id, doc_id, block_no, text``: a passage's id is of document, place and collapsed text; the first block keeps it."""
    named = blocks.withColumn("passage_id", digest([F.col("doc_id").cast("string"), location, collapsed(F.col("text"))], 12))
    first = named.groupBy("doc_id", "passage_id").agg(F.min_by(F.struct("block_no", "text"), "block_no").alias("b"))
    return first.select("passage_id", "doc_id", "b.block_no", "b.text")


def greedy_batches(blocks: DataFrame, budget: int = 6000, min_chars: int = 1500) -> DataFrame:
    """``doc_id, batch_no, n_blocks, n_chars, first_block, last_block``: consecutive blocks up to ``budget`` characters.

    ``blocks``: ``doc_id, block_no, text`` and, if a batch of ``min_chars`` or more is to end where one does, ``section``. A block over the budget
    is a batch of its own. Where a batch begins depends on where the last one did, so the blocks of a document are
    sorted within a partition and folded as they pass; only the open batch is kept. No text moves.
    """
    kinds = {f.name: f.dataType.simpleString() for f in blocks.schema}
    section = F.col("section").cast("string") if "section" in kinds else F.lit(None).cast("string")
    rows = blocks.select("doc_id", "block_no", F.length("text").alias("n"), section.alias("section"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_batch: list | None = None  # document, batch, blocks, characters, first and last block, section of the last

        def closed(done: list, kind: pa.DataType) -> pa.RecordBatch:
            columns = [pa.array([r[0] for r in done], kind), *(pa.array([r[k] for r in done], pa.int64()) for k in range(1, 6))]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "batch_no", "n_blocks", "n_chars", "first_block", "last_block"])

        kind = None
        for batch in batches:
            kind, done = batch.column("doc_id").type, []
            for name, block, n, part in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "block_no", "n", "section")), strict=True):
                if open_batch is None or name != open_batch[0]:
                    done += [open_batch] if open_batch else []
                    open_batch = [name, 0, 0, 0, block, block, part]
                elif open_batch[3] + n > budget or (part != open_batch[6] and open_batch[3] >= min_chars):
                    done.append(open_batch)
                    open_batch = [name, open_batch[1] + 1, 0, 0, block, block, part]
                open_batch[2:] = [open_batch[2] + 1, open_batch[3] + n, open_batch[4], block, part]
            yield closed(done, kind)
        if open_batch:
            yield closed([open_batch], kind)

    ordered = rows.repartition("doc_id").sortWithinPartitions("doc_id", "block_no")
    return ordered.mapInArrow(fold, f"doc_id {kinds['doc_id']}, batch_no long, n_blocks long, n_chars long, first_block long, last_block long")


def batch_context(batches: DataFrame) -> DataFrame:
    """Each batch with the last block of the batch before and the first block of the next."""
    order = Window.partitionBy("doc_id").orderBy("batch_no")
    return batches.withColumns({"before": F.lag("last_block").over(order), "after": F.lead("first_block").over(order)})


def render_batches(blocks: DataFrame, batches: DataFrame) -> DataFrame:
    """``doc_id, batch_no, core, rendered``: each batch as text, a labelled paragraph for each passage, and how many are its own.

    ``blocks``: ``doc_id, block_no, location, text``. The labels P1, P2, ... run through the last passage of the batch before, the batch's own
    and the first of the next one. A batch has bounded characters, so a row has as well.
    """
    context = batch_context(batches)
    mine = context.select("doc_id", "batch_no", "before", "after", "first_block", "last_block")
    low, high = F.coalesce("before", "first_block"), F.coalesce("after", "last_block")
    # Batches list the places that they cover, so that blocks are met by place and not by document alone.
    rows = mine.withColumn("block_no", F.explode(F.sequence(low, high))).join(blocks.withColumn("block_no", F.col("block_no").cast("bigint")), ["doc_id", "block_no"])
    listed = rows.groupBy("doc_id", "batch_no").agg(F.array_sort(F.collect_list(F.struct("block_no", "location", "text"))).alias("p"), F.count_if(F.col("block_no").between(F.col("first_block"), F.col("last_block"))).alias("core"))
    paragraphs = F.transform("p", lambda x, k: F.concat(F.lit("[P"), (k + 1).cast("string"), F.lit("] ("), x["location"], F.lit(")\n"), x["text"]))
    return listed.select("doc_id", "batch_no", "core", F.array_join(paragraphs, "\n\n").alias("rendered"))


def section_changes(rows: DataFrame, group: str, order: str, section: str) -> DataFrame:
    """Rows with ``changes``: whether the section differs from the row before; the first always does."""
    w = Window.partitionBy(group).orderBy(order)
    return rows.withColumn("changes", ~F.col(section).eqNullSafe(F.lag(section).over(w)) | (F.row_number().over(w) == 1))


def sentences(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, sentence_no, sentence``: split after . ! ? before white space and a capital."""
    parts = F.split(F.col(text), SENTENCE_END)
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(parts).alias("sentence_no", "sentence"))


def quantities(docs: DataFrame, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, place, quantity``: every match of a number and its unit."""
    found = F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0))
    return docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("place", "quantity"))


def limits(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, place, name, number, quote``: quantities of one to three words that a limiting phrase introduces.

    A number in digits or words counts; quote and name are without punctuation at their ends.
    """
    found = F.arrays_zip(*[F.regexp_extract_all(F.col(text), F.lit(LIMIT), F.lit(k)).alias(c) for k, c in ((0, "quote"), (2, "figure"), (3, "unit"))])
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.posexplode(found).alias("place", "m")).select("doc_id", "place", "m.*")
    ends = r"^[ \t.,;:]+|[ \t.,;:]+$"
    rows = rows.select("doc_id", "place", as_number(F.col("figure")).alias("number"), F.regexp_replace("unit", ends, "").alias("unit"), F.regexp_replace("quote", ends, "").alias("quote"))
    return rows.filter("number IS NOT NULL AND unit <> ''").select("doc_id", "place", F.concat_ws(" ", F.col("number").cast("string"), "unit").alias("name"), "number", "quote")


def modal_severity(sentence: Column, words: Sequence[tuple[str, str]] = MODALS, default: str | None = None) -> Column:
    """The severity of the first pattern, in their order, that a sentence matches."""
    out = F.lit(default)
    for pattern, severity in reversed(words):
        out = F.when(sentence.rlike(pattern), severity).otherwise(out)
    return out


def harvest(passages: DataFrame) -> DataFrame:
    """``head, head_type, relation, tail, tail_type, passage_id, quote, method``: candidates that patterns alone find, as ``admit`` takes them.

    ``passages``: ``passage_id, text``, and perhaps ``kind``; images and null texts have none. Each limit is a value, named by its number and unit, with its number; each sentence with a modal verb
    a rule, with its wording and how hard it bites. What a rule requires is not for patterns to say. The same limit or sentence twice in a passage is two candidates.
    """
    texts = passages.filter("kind IS NULL OR kind <> 'image'") if "kind" in passages.columns else passages
    texts = texts.select(F.col("passage_id").alias("doc_id"), "text")
    fixed = [F.lit("literal").alias("tail_type"), F.col("doc_id").alias("passage_id"), F.col("quote"), F.lit("deterministic").alias("method")]
    values = limits(texts).select(F.col("name").alias("head"), F.lit("Value").alias("head_type"), F.lit("VALUE_IS").alias("relation"), F.col("number").cast("string").alias("tail"), *fixed)
    said = sentences(texts).withColumn("quote", F.regexp_replace("sentence", r"^[ \t.,;:]+|[ \t.,;:]+$", "")).filter("quote <> ''").withColumn("severity", modal_severity(F.col("quote"))).filter("severity IS NOT NULL")
    pair = F.explode(F.array(F.struct(F.lit("RULE_STATES").alias("relation"), F.col("quote").alias("tail")), F.struct(F.lit("HAS_SEVERITY").alias("relation"), F.col("severity").alias("tail"))))
    rules = said.select("doc_id", "quote", pair.alias("p")).select(F.col("quote").alias("head"), F.lit("Rule").alias("head_type"), "p.relation", "p.tail", *fixed)
    return values.unionByName(rules)


def passes(quotes: DataFrame, chars: int) -> Iterator[list[tuple]]:
    """``(item_id, quote)`` by passes: those of each, about ``chars`` characters, are all that the driver holds at a time."""
    total = quotes.agg(F.sum(F.length("quote"))).first()[0] or 0
    n = -(-total // chars)
    slot = F.pmod(F.xxhash64("quote"), F.lit(max(1, n)))
    for k in range(n):
        yield [(r["item_id"], r["quote"]) for r in quotes.filter(slot == k).collect()]


def scan_quotes(texts: DataFrame, quotes: DataFrame, chars: int = AUTOMATON_CHARS) -> DataFrame:
    """``item_id, doc_id, start``: the first place of each quote in each text that holds it, from 0.

    An automaton of all quotes goes over every text once, whatever their number; where they have more than ``chars`` characters, several do, one after the other. Nulls and empty quotes are in nothing.
    """
    spark, out = texts.sparkSession, None
    kinds = {f.name: f.dataType for f in [*texts.schema, *quotes.schema]}
    schema = f"item_id {kinds['item_id'].simpleString()}, doc_id {kinds['doc_id'].simpleString()}, start int"
    rows = texts.select("doc_id", "text").filter("text IS NOT NULL")

    def scan(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ids: dict[str, list] = {}
            for item, quote in shared.value:
                ids.setdefault(quote, []).append(item)
            seeker = ahocorasick.Automaton()
            for quote in ids:
                seeker.add_word(quote, quote)
            seeker.make_automaton()
            for batch in batches:
                at, items, starts = [], [], []
                for k, text in enumerate(batch.column(1)):
                    first: dict[str, int] = {}
                    for end, quote in seeker.iter(text.as_py()):
                        first.setdefault(quote, end - len(quote) + 1)
                    for quote, start in first.items():
                        at += [k] * len(ids[quote])
                        items += ids[quote]
                        starts += [start] * len(ids[quote])
                columns = [pa.array(items, to_arrow_type(kinds["item_id"])), batch.column(0).take(pa.array(at, pa.int64())), pa.array(starts, pa.int32())]
                yield pa.RecordBatch.from_arrays(columns, ["item_id", "doc_id", "start"])

        return found

    for some in passes(quotes.filter("quote <> ''").select("item_id", "quote"), chars):
        part = rows.mapInArrow(scan(spark.sparkContext.broadcast(some)), schema)
        out = part if out is None else out.unionByName(part)
    return spark.createDataFrame([], schema) if out is None else out


def locate_quotes(quotes: DataFrame, texts: DataFrame, grams: int = 3, min_chars: int = 8) -> DataFrame:
    """``item_id, doc_id, start``: where each quote begins in each text that holds it, from 0.

    A text that holds a quote holds the quote's second to ``grams + 1``st word as whole words, so
    texts and quotes meet by that run of words; the rest is verified. Quotes of fewer than
    ``grams + 2`` words have no such run: an automaton of all of them goes over the texts (see ``scan_quotes``). Quotes of fewer than ``min_chars``
    characters, without blanks at their ends, are refused.
    """
    quotes = quotes.filter(F.length(F.regexp_replace("quote", r"^\s+|\s+$", "")) >= min_chars)
    words = F.split("quote", " ")
    # Runs meet by their hashes: a chance hit is found out when the text is searched.
    keyed = quotes.withColumn("gram", F.when(F.size(words) >= grams + 2, F.xxhash64(F.slice(words, 2, grams)))).filter("gram IS NOT NULL")
    text_words = texts.withColumn("w", F.split("text", " "))
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - grams + 1)), lambda k: F.xxhash64(F.slice("w", k, grams)))
    met = text_words.select("doc_id", F.explode(F.array_distinct(runs)).alias("gram")).join(keyed.select("gram").distinct(), "gram", "left_semi")
    pairs = met.join(keyed.select("gram", "item_id"), "gram").select("doc_id", "item_id").distinct()
    found = pairs.join(quotes.select("item_id", "quote"), "item_id").join(texts, "doc_id")
    found = found.select("item_id", "doc_id", (F.expr("instr(text, quote)") - 1).alias("start")).filter("start >= 0")
    short = scan_quotes(texts, quotes.filter(F.size(words) < grams + 2))
    return found.unionByName(short)


def locate_spans(quotes: DataFrame, texts: DataFrame, min_chars: int = 8) -> DataFrame:
    """``item_id, doc_id, start, end, exact``: where each quote stands in each text that holds it, as places in the source text.

    A quote is sought as it is and, where a text lacks it so, with typography, case and white space folded. Only texts that hold
    a quote are gone through for their offsets. ``quotes``: ``item_id, quote``; ``texts``: ``doc_id, text``.
    """
    plain = locate_quotes(quotes, texts, min_chars=min_chars)
    loose = locate_quotes(quotes.filter(F.length(F.trim("quote")) >= min_chars).select("item_id", folded(F.col("quote")).alias("quote")), texts.select("doc_id", folded(F.col("text")).alias("text")), min_chars=1)
    hits = loose.select("item_id", "doc_id").unionByName(plain.select("item_id", "doc_id")).distinct()
    rows = hits.join(quotes.select("item_id", "quote"), "item_id").join(texts.select("doc_id", "text"), "doc_id")
    span = source_span(F.col("quote"), F.col("text"))
    return rows.select("item_id", "doc_id", span.alias("s")).select("item_id", "doc_id", "s.start", "s.end", "s.exact").filter("start IS NOT NULL")
