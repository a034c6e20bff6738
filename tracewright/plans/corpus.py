"""Queries of the corpus operators, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tracewright.functions import text as T
from tracewright.operators import corpus as C
from tracewright.storage import stash, table

QUANTITY = r"[0-9]+ [A-Za-z]+"
#: What clerks may or must do, for sentences made of orders.
VERBS = ("must not", "never", "must", "are required to", "should not", "ought to", "may", "can", "like to", "CANNOT")
#: Words of the tables' invented languages stand in for the modal verbs of policies.
STAND_INS = [(r"(^| )(with|mit|con|avec)( |$)", "blocker"), (r"(^| )(from|von|por)( |$)", "error"), (r"(^| )(and|und|et|y)( |$)", "warning")]


def canonical_fold(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.sha2(T.canonical_name(F.col("text")), 256).alias("canonical_sha256"))


def value_canonical(spark: SparkSession, d: str) -> DataFrame:
    """Quantities of documents, decimals with units of two words, and names that are no quantities."""
    found = C.quantities(table(spark, d, "documents"), QUANTITY).select("quantity")
    found = found.unionByName(table(spark, d, "lineitem").select(F.format_string(" %s Total Attempts ", F.col("l_quantity").cast("string")).alias("quantity")))
    found = found.unionByName(table(spark, d, "part").select(F.concat(F.lit("Seven "), "p_name").alias("quantity")))
    # Quantities repeat, so each distinct one is named once; they are read twice, so texts aren't.
    counted = stash(found.groupBy("quantity").agg(F.count("*").alias("n")), "quantities")
    return T.with_canonical(counted, "quantity", "value", T.canonical_value).groupBy("value").agg(F.sum("n").alias("n"))


def entity_ids(spark: SparkSession, d: str) -> DataFrame:
    parts = table(spark, d, "part").select(F.lit("Part").alias("kind"), F.col("p_name").alias("name"))
    rows = parts.unionByName(table(spark, d, "nation").select(F.lit("Nation").alias("kind"), F.col("n_name").alias("name")))
    named = rows.withColumn("canonical", T.canonical_name(F.col("name"), ascii_only=True))
    return named.select("kind", "canonical", T.entity_id(F.col("kind"), F.col("canonical")).alias("entity_id")).distinct()


def number_words(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "lineitem").select(T.as_number(F.col("l_linenumber").cast("string")).alias("n"), "l_quantity")
    return rows.groupBy("n").agg(F.count("*").alias("lines"), F.sum("l_quantity").alias("quantity"))


def blocks_lines(spark: SparkSession, d: str) -> DataFrame:
    return C.line_blocks(table(spark, d, "documents")).select("doc_id", F.col("block_no").cast("bigint").alias("block_no"), "text")


def blocks_markup(spark: SparkSession, d: str) -> DataFrame:
    return C.markup_blocks(table(spark, d, "pages")).select("page_id", F.col("block_no").cast("bigint").alias("block_no"), "kind", "text")


def table_row_render(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "supplier")
    text = C.row_text([("Name", F.col("s_name")), ("", F.col("s_suppkey")), ("Nation", F.when(F.col("s_nationkey") % 2 == 0, F.col("s_nationkey")))])
    return rows.select("s_suppkey", text.alias("rendered"))


def furniture_find(spark: SparkSession, d: str) -> DataFrame:
    return C.find_furniture(C.line_blocks(table(spark, d, "documents")), min_repeats=2)


def furniture_strip(spark: SparkSession, d: str) -> DataFrame:
    blocks = C.line_blocks(table(spark, d, "documents"))
    kept = C.strip_furniture(blocks, C.find_furniture(blocks, min_repeats=2))
    return kept.groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.sum(F.length("text").cast("bigint")).alias("n_chars"))


def passages_dedup(spark: SparkSession, d: str) -> DataFrame:
    found = C.passages(C.line_blocks(table(spark, d, "documents")), F.lit("(root)"))
    return found.select("passage_id", "doc_id", F.col("block_no").cast("bigint").alias("block_no"))


def batch_greedy(spark: SparkSession, d: str) -> DataFrame:
    found = C.greedy_batches(C.line_blocks(table(spark, d, "documents")), budget=1500)
    return found.select("doc_id", "batch_no", "n_blocks", "n_chars", "first_block", "last_block")


def batch_sections(spark: SparkSession, d: str) -> DataFrame:
    """Batches of pages, which end before a heading once they have 300 characters."""
    blocks = C.markup_blocks(table(spark, d, "pages"))
    own = Window.partitionBy("page_id").orderBy("block_no")
    headed = blocks.withColumn("section", F.last(F.when(F.col("kind") == "heading", F.col("block_no")), ignorenulls=True).over(own))
    return C.greedy_batches(headed.withColumnRenamed("page_id", "doc_id"), budget=900, min_chars=300).withColumnRenamed("doc_id", "page_id")


def batch_render(spark: SparkSession, d: str) -> DataFrame:
    blocks = C.line_blocks(table(spark, d, "documents")).withColumn("location", F.concat(F.lit("line "), F.col("block_no").cast("string")))
    found = C.render_batches(blocks, C.greedy_batches(blocks, budget=1500))
    return found.select("doc_id", "batch_no", "core", F.sha2("rendered", 256).alias("rendered_sha256"))


def batch_context(spark: SparkSession, d: str) -> DataFrame:
    found = C.batch_context(C.greedy_batches(C.line_blocks(table(spark, d, "documents")), budget=1500))
    return found.select("doc_id", *[F.col(c).cast("bigint").alias(c) for c in ("batch_no", "before", "after")])


def section_change(spark: SparkSession, d: str) -> DataFrame:
    return C.section_changes(table(spark, d, "conversations"), "conv_id", "turn", "role").select("conv_id", "turn", "changes")


def sentence_split(spark: SparkSession, d: str) -> DataFrame:
    return C.sentences(table(spark, d, "documents")).select("doc_id", F.col("sentence_no").cast("bigint").alias("sentence_no"), F.sha2("sentence", 256).alias("sentence_sha256"))


def harvest_quantities(spark: SparkSession, d: str) -> DataFrame:
    return C.quantities(table(spark, d, "documents"), QUANTITY).select("doc_id", F.col("place").cast("bigint").alias("place"), "quantity")


def harvest_modal_severity(spark: SparkSession, d: str) -> DataFrame:
    rows = C.sentences(table(spark, d, "documents")).withColumn("severity", C.modal_severity(F.col("sentence"), STAND_INS, "info"))
    return rows.groupBy("doc_id", "severity").agg(F.count("*").alias("n"))


def harvest_limits(spark: SparkSession, d: str) -> DataFrame:
    """Limits in sentences made of the parts' sizes and types."""
    k, size = F.col("p_partkey"), F.col("p_size")
    figure = F.when(size <= 10, F.element_at(F.array(*[F.lit(w.title()) for w in T.NUMBER_WORDS]), F.least(size, F.lit(10)))).otherwise(size.cast("string"))
    phrase = F.element_at(F.array(*[F.lit(x) for x in ("at most", "No more than", "about", "within", "up  to")]), (k % 5 + 1).cast("int"))
    text = F.concat(F.lit("Stock "), phrase, F.lit(" "), figure, F.lit(" "), F.lower("p_type"), F.lit(" a day, and at least 3 days' supply; see 12 boxes."))
    return C.limits(table(spark, d, "part").select(k.alias("doc_id"), text.alias("text"))).select("doc_id", F.col("place").cast("bigint").alias("place"), "name", "number", "quote")


def harvest_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Candidates out of two sentences about each part: a limit in one, a modal verb in the other."""
    k = F.col("p_partkey")
    verb = F.element_at(F.array(*[F.lit(x) for x in VERBS]), (k % len(VERBS) + 1).cast("int"))
    text = F.concat(F.lit("Keep up to "), F.col("p_size"), F.lit(" boxes of it. "), F.lit("Clerks "), verb, F.lit(" sell "), "p_brand", F.lit("."))
    kind = F.when(k % 9 == 0, "image").otherwise("prose")
    return C.harvest(table(spark, d, "part").select(k.alias("passage_id"), kind.alias("kind"), text.alias("text")))


def harvest_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules in sentences made of orders: how hard each bites."""
    verb = F.element_at(F.array(*[F.lit(x) for x in VERBS]), (F.col("o_orderkey") % len(VERBS) + 1).cast("int"))
    sentence = F.concat(F.lit("Clerks "), verb, F.lit(" ship orders of priority "), "o_orderpriority", F.lit("."))
    rows = table(spark, d, "orders").select("o_orderpriority", C.modal_severity(sentence).alias("severity"))
    return rows.filter("severity IS NOT NULL").groupBy("o_orderpriority", "severity").agg(F.count("*").alias("n"))


def locate_spans(spark: SparkSession, d: str) -> DataFrame:
    """What stands at the places found for each quote, written in capitals and curly marks, folded again."""
    docs = table(spark, d, "documents").select("doc_id", "text")
    found = C.locate_spans(table(spark, d, "benchmark").select("item_id", F.translate("text", "abcdefghijklmnopqrstuvwxyz-'", "ABCDEFGHIJKLMNOPQRSTUVWXYZ–’").alias("quote")), docs)
    there = found.join(docs, "doc_id").withColumn("found", T.folded(F.substring("text", F.col("start") + 1, F.col("end") - F.col("start"))))
    return there.select("item_id", "doc_id", F.sha2("found", 256).alias("found_sha256"), (F.col("start") >= 0).alias("placed"))


def locate_quote_exact(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "benchmark").select("item_id", F.col("text").alias("quote"))
    found = C.locate_quotes(quotes, table(spark, d, "documents").select("doc_id", "text"))
    return found.select("item_id", "doc_id", F.col("start").cast("bigint").alias("start"))


def locate_quote_folded(spark: SparkSession, d: str) -> DataFrame:
    quotes = table(spark, d, "benchmark").select("item_id", T.folded(F.col("text")).alias("quote"))
    found = C.locate_quotes(quotes, table(spark, d, "documents").select("doc_id", T.folded(F.col("text")).alias("text")))
    return found.select("item_id", "doc_id", F.col("start").cast("bigint").alias("start"))


def build_identity(spark: SparkSession, d: str) -> DataFrame:
    """One digest for each source, over its documents' digests in order, and how many there are."""
    rows = table(spark, d, "documents").select("source", F.sha2(F.col("text"), 256).alias("sha"), "doc_id")
    # Digests of digests, by thousands of documents, of these groups and so on: every list is short, however large a source is.
    parts = rows.select("source", F.floor(F.col("doc_id") / 1000).alias("part"), F.concat_ws(":", "sha", F.col("doc_id")).alias("sha"), F.lit(1).alias("n"))
    for _ in range(6):
        parts = parts.groupBy("source", "part").agg(F.sha2(F.concat_ws("|", F.array_sort(F.collect_list("sha"))), 256).alias("sha"), F.sum("n").alias("n")).withColumn("part", F.floor(F.col("part") / 1000))
    return parts.select("source", F.left("sha", F.lit(16)).alias("corpus_hash"), F.col("n").alias("n_documents"))


FOLD = "translate({x}, '‘’‚‛“”–—−‐‑' || chr(160), '''''''''\"\"----- ')"
WS = r"trim(regexp_replace({x}, '[ \t\n\x0B\f\r]+', ' ', 'g'))"
BLOCKS = "blocks AS (SELECT doc_id, no - 1 AS block_no, trim(line, ' ') AS text FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS no FROM documents) WHERE trim(line, ' ') <> '')"
SENTENCES = r"sentences AS (SELECT doc_id, unnest(s) AS sentence, generate_subscripts(s, 1) - 1 AS sentence_no FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-Z])', '\1' || chr(30) || '\2', 'g'), chr(30)) AS s FROM documents))"
BATCHES = f"""
WITH RECURSIVE {BLOCKS}, numbered AS (SELECT doc_id, block_no, length(text) AS n, row_number() OVER (PARTITION BY doc_id ORDER BY block_no) AS k FROM blocks),
fold AS (
    SELECT doc_id, k, block_no, n, 0 AS batch_no, n AS size FROM numbered WHERE k = 1
    UNION ALL
    SELECT b.doc_id, b.k, b.block_no, b.n, CASE WHEN f.size = 0 OR f.size + b.n <= 1500 THEN f.batch_no ELSE f.batch_no + 1 END,
        CASE WHEN f.size = 0 OR f.size + b.n <= 1500 THEN f.size + b.n ELSE b.n END
    FROM fold f JOIN numbered b ON b.doc_id = f.doc_id AND b.k = f.k + 1
), batches AS (SELECT doc_id, batch_no::BIGINT AS batch_no, count(*) AS n_blocks, sum(n)::BIGINT AS n_chars, min(block_no)::BIGINT AS first_block, max(block_no)::BIGINT AS last_block FROM fold GROUP BY ALL)
"""
MARKUP = rf"""marked AS (SELECT page_id, regexp_extract_all(html, '(?s)<(h1|li|p)\b[^>]*>(.*?)</(?:h1|li|p)>') AS found FROM pages),
raws AS (SELECT page_id, unnest(found) AS raw, generate_subscripts(found, 1) - 1 AS block_no FROM marked),
mblocks AS (SELECT page_id, block_no, CASE regexp_extract(raw, '^<(h1|li|p)', 1) WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list' ELSE 'paragraph' END AS kind, {WS.format(x="regexp_replace(raw, '<[^>]*>', ' ', 'g')")} AS text
    FROM raws WHERE {WS.format(x="regexp_replace(raw, '<[^>]*>', ' ', 'g')")} <> '')"""
SECTIONS = f"""
WITH RECURSIVE {MARKUP}, headed AS (SELECT page_id, block_no, length(text) AS n, last_value(CASE WHEN kind = 'heading' THEN block_no END IGNORE NULLS) OVER (PARTITION BY page_id ORDER BY block_no) AS section, row_number() OVER (PARTITION BY page_id ORDER BY block_no) AS k FROM mblocks),
fold AS (
    SELECT page_id, k, block_no, section, n, 0 AS batch_no, n AS size FROM headed WHERE k = 1
    UNION ALL
    SELECT page_id, k, block_no, section, n, batch_no + ends::INT, CASE WHEN ends THEN n ELSE size + n END FROM (
        SELECT b.*, f.batch_no, f.size, f.size + b.n > 900 OR (b.section IS DISTINCT FROM f.section AND f.size >= 300) AS ends FROM fold f JOIN headed b ON b.page_id = f.page_id AND b.k = f.k + 1)
)
"""


def _located(fold: bool) -> str:
    f = (lambda x: WS.format(x=f"lower({FOLD.format(x=x)})")) if fold else (lambda x: x)
    return f"""
SELECT item_id, doc_id, (strpos(d, q) - 1)::BIGINT AS start FROM (SELECT item_id, {f('text')} AS q FROM benchmark), (SELECT doc_id, {f('text')} AS d FROM documents)
WHERE contains(d, q) AND length(trim(q)) >= 8"""


LIMIT_SQL = r"(?i)\b(maximum of|minimum of|no more than|no fewer than|at most|at least|up to|within)\s+(\d+|one|two|three|four|five|six|seven|eight|nine|ten)\s+((?:[A-Za-z][A-Za-z-]*\s+){0,2}[A-Za-z][A-Za-z-]*)"
IDENTITY = "WITH p0 AS (SELECT source, doc_id // 1000 AS part, sha256(text) || ':' || doc_id AS sha, 1 AS n FROM documents)" + "".join(f", p{k} AS (SELECT source, part // 1000 AS part, sha, n FROM (SELECT source, part, sha256(string_agg(sha, '|' ORDER BY sha)) AS sha, sum(n) AS n FROM p{k - 1} GROUP BY source, part))" for k in range(1, 7)) + " "

QUERIES = {
    "canonical_fold": (canonical_fold, "SELECT doc_id, sha256(regexp_replace(regexp_replace(lower(strip_accents(text)), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')) AS canonical_sha256 FROM documents"),
    "value_canonical": (
        value_canonical,
        r"""
WITH q AS (SELECT unnest(regexp_extract_all(text, '[0-9]+ [A-Za-z]+')) AS q FROM documents UNION ALL SELECT ' ' || l_quantity::VARCHAR || ' Total Attempts ' FROM lineitem UNION ALL SELECT 'Seven ' || p_name FROM part),
p AS (SELECT q, regexp_extract(q, '^\s*(\d+(?:\.\d+)?)\s+(.*\S)\s*$', 1) AS n, string_split(lower(regexp_extract(q, '^\s*(\d+(?:\.\d+)?)\s+(.*\S)\s*$', 2)), ' ')[-1] AS w FROM q)
SELECT CASE WHEN n = '' THEN regexp_replace(regexp_replace(lower(q), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')
    ELSE replace(n, '.', '_') || '_' || CASE WHEN length(w) > 3 AND regexp_matches(w, 's$') AND NOT regexp_matches(w, '(ss|us|is|as|os)$') THEN regexp_replace(w, 's$', '') ELSE w END END AS value, count(*) AS n
FROM p GROUP BY 1""",
    ),
    "entity_ids": (
        entity_ids,
        """
WITH r AS (SELECT 'Part' AS kind, p_name AS name FROM part UNION ALL SELECT 'Nation', n_name FROM nation),
c AS (SELECT kind, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS canonical FROM r)
SELECT DISTINCT kind, canonical, CASE WHEN canonical <> '' THEN kind || ':' || left(sha256(kind || chr(31) || canonical), 10) END AS entity_id FROM c""",
    ),
    "number_words": (number_words, "SELECT l_linenumber::BIGINT AS n, count(*) AS lines, sum(l_quantity) AS quantity FROM lineitem GROUP BY 1"),
    "blocks_lines": (blocks_lines, f"WITH {BLOCKS} SELECT doc_id, block_no, text FROM blocks"),
    "blocks_markup": (
        blocks_markup,
        rf"""
WITH f AS (SELECT page_id, regexp_extract_all(html, '(?s)<(h1|li|p)\b[^>]*>(.*?)</(?:h1|li|p)>') AS found FROM pages),
r AS (SELECT page_id, unnest(found) AS raw, generate_subscripts(found, 1) - 1 AS block_no FROM f)
SELECT page_id, block_no, CASE regexp_extract(raw, '^<(h1|li|p)', 1) WHEN 'h1' THEN 'heading' WHEN 'li' THEN 'list' ELSE 'paragraph' END AS kind, {WS.format(x="regexp_replace(raw, '<[^>]*>', ' ', 'g')")} AS text
FROM r WHERE {WS.format(x="regexp_replace(raw, '<[^>]*>', ' ', 'g')")} <> ''""",
    ),
    "table_row_render": (table_row_render, "SELECT s_suppkey, 'Name: ' || s_name || ' | column 2: ' || s_suppkey || CASE WHEN s_nationkey % 2 = 0 THEN ' | Nation: ' || s_nationkey ELSE '' END AS rendered FROM supplier"),
    "furniture_find": (furniture_find, f"WITH {BLOCKS} SELECT doc_id, text, count(*) AS n FROM blocks WHERE length(text) <= 90 GROUP BY ALL HAVING count(*) >= 2"),
    "furniture_strip": (
        furniture_strip,
        f"WITH {BLOCKS}, f AS (SELECT doc_id, text FROM blocks WHERE length(text) <= 90 GROUP BY ALL HAVING count(*) >= 2) SELECT doc_id, count(*) AS n_blocks, sum(length(text))::BIGINT AS n_chars FROM blocks ANTI JOIN f USING (doc_id, text) GROUP BY 1",
    ),
    "passages_dedup": (
        passages_dedup,
        f"WITH {BLOCKS} SELECT left(sha256(doc_id || chr(31) || '(root)' || chr(31) || {WS.format(x='text')}), 12) AS passage_id, doc_id, min(block_no) AS block_no FROM blocks GROUP BY 1, 2",
    ),
    "batch_greedy": (batch_greedy, BATCHES + "SELECT * FROM batches"),
    "batch_context": (batch_context, BATCHES + "SELECT doc_id, batch_no, lag(last_block) OVER w AS before, lead(first_block) OVER w AS after FROM batches WINDOW w AS (PARTITION BY doc_id ORDER BY batch_no)"),
    "batch_render": (
        batch_render,
        BATCHES + """, cx AS (SELECT *, coalesce(lag(last_block) OVER w, first_block) AS low, coalesce(lead(first_block) OVER w, last_block) AS high FROM batches WINDOW w AS (PARTITION BY doc_id ORDER BY batch_no)),
r AS (SELECT c.doc_id, c.batch_no, b.block_no, b.text, b.block_no BETWEEN first_block AND last_block AS own, row_number() OVER (PARTITION BY c.doc_id, c.batch_no ORDER BY b.block_no) AS k FROM cx c JOIN blocks b ON b.doc_id = c.doc_id AND b.block_no BETWEEN low AND high)
SELECT doc_id, batch_no, count(*) FILTER (own) AS core, sha256(string_agg('[P' || k || '] (line ' || block_no || ')' || chr(10) || text, chr(10) || chr(10) ORDER BY k)) AS rendered_sha256 FROM r GROUP BY 1, 2""",
    ),
    "batch_sections": (batch_sections, SECTIONS + "SELECT page_id, batch_no::BIGINT AS batch_no, count(*) AS n_blocks, sum(n)::BIGINT AS n_chars, min(block_no)::BIGINT AS first_block, max(block_no)::BIGINT AS last_block FROM fold GROUP BY 1, 2"),
    "section_change": (section_change, "SELECT conv_id, turn, role IS DISTINCT FROM lag(role) OVER w OR row_number() OVER w = 1 AS changes FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)"),
    "sentence_split": (sentence_split, f"WITH {SENTENCES} SELECT doc_id, sentence_no, sha256(sentence) AS sentence_sha256 FROM sentences"),
    "harvest_quantities": (
        harvest_quantities,
        "SELECT doc_id, generate_subscripts(q, 1) - 1 AS place, unnest(q) AS quantity FROM (SELECT doc_id, regexp_extract_all(text, '[0-9]+ [A-Za-z]+') AS q FROM documents)",
    ),
    "harvest_modal_severity": (
        harvest_modal_severity,
        rf"""WITH {SENTENCES} SELECT doc_id, CASE WHEN regexp_matches(sentence, '(^| )(with|mit|con|avec)( |$)') THEN 'blocker' WHEN regexp_matches(sentence, '(^| )(from|von|por)( |$)') THEN 'error'
WHEN regexp_matches(sentence, '(^| )(and|und|et|y)( |$)') THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM sentences GROUP BY ALL""",
    ),
    "locate_quote_exact": (locate_quote_exact, _located(False)),
    "locate_quote_folded": (locate_quote_folded, _located(True)),
    "build_identity": (build_identity, IDENTITY + "SELECT source, left(sha, 16) AS corpus_hash, n::BIGINT AS n_documents FROM p6"),
    "harvest_limits": (
        harvest_limits,
        rf"""
WITH t AS (SELECT p_partkey AS doc_id, 'Stock ' || ['at most', 'No more than', 'about', 'within', 'up  to'][p_partkey % 5 + 1] || ' ' || coalesce(['One', 'Two', 'Three', 'Four', 'Five', 'Six', 'Seven', 'Eight', 'Nine', 'Ten'][p_size], p_size::VARCHAR)
    || ' ' || lower(p_type) || ' a day, and at least 3 days'' supply; see 12 boxes.' AS text FROM part),
m AS (SELECT doc_id, unnest(regexp_extract_all(text, '{LIMIT_SQL}')) AS quote, generate_subscripts(regexp_extract_all(text, '{LIMIT_SQL}'), 1) - 1 AS place FROM t),
x AS (SELECT *, regexp_extract(quote, '{LIMIT_SQL}', 2) AS figure, regexp_extract(quote, '{LIMIT_SQL}', 3) AS unit FROM m),
y AS (SELECT *, coalesce(try_cast(figure AS BIGINT), list_position(['one', 'two', 'three', 'four', 'five', 'six', 'seven', 'eight', 'nine', 'ten'], lower(figure))::BIGINT) AS number FROM x)
SELECT doc_id, place, number || ' ' || unit AS name, number, quote FROM y""",
    ),
    "harvest_candidates": (
        harvest_candidates,
        """WITH p AS (SELECT *, p_partkey % 10 AS k, 'Clerks ' || ['must not', 'never', 'must', 'are required to', 'should not', 'ought to', 'may', 'can', 'like to', 'CANNOT'][p_partkey % 10 + 1] || ' sell ' || p_brand AS rule FROM part WHERE p_partkey % 9 > 0),
c AS (SELECT p_size || ' boxes of it' AS head, 'Value' AS head_type, 'VALUE_IS' AS relation, p_size::VARCHAR AS tail, p_partkey AS passage_id, 'up to ' || p_size || ' boxes of it' AS quote FROM p
    UNION ALL SELECT rule, 'Rule', 'RULE_STATES', rule, p_partkey, rule FROM p WHERE k <> 8
    UNION ALL SELECT rule, 'Rule', 'HAS_SEVERITY', CASE WHEN k IN (0, 1, 2, 3, 9) THEN 'error' WHEN k IN (4, 5) THEN 'warning' ELSE 'info' END, p_partkey, rule FROM p WHERE k <> 8)
SELECT *, 'literal' AS tail_type, 'deterministic' AS method FROM c""",
    ),
    "harvest_rules": (
        harvest_rules,
        """
WITH v AS (SELECT o_orderpriority, o_orderkey % 10 AS k FROM orders)
SELECT o_orderpriority, CASE WHEN k IN (0, 1, 2, 3, 9) THEN 'error' WHEN k IN (4, 5) THEN 'warning' ELSE 'info' END AS severity, count(*) AS n FROM v WHERE k <> 8 GROUP BY 1, 2""",
    ),
    "locate_spans": (locate_spans, f"""
SELECT item_id, doc_id, sha256(q) AS found_sha256, true AS placed FROM (SELECT item_id, {WS.format(x="lower(" + FOLD.format(x="text") + ")")} AS q FROM benchmark), (SELECT doc_id, {WS.format(x="lower(" + FOLD.format(x="text") + ")")} AS d FROM documents)
WHERE contains(d, q) AND length(q) >= 8"""),
}
