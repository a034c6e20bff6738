"""Readers on small files."""

import gzip
import hashlib
import json
import zipfile

import pytest
from pyspark.sql import functions as F

from tracewright.sources import builds, canonical, catalogues, documents, office, telemetry

TEXT = """# Top

Intro with **bold** and
`code` going on.

- first point
  goes on
- second

## Part
| Name | Value | |
|---|:-:|---|
| a_b | 1 | x |
| c |  | |

### Deep
text
# Next
last
"""


def test_markdown_blocks(spark):
    df = spark.createDataFrame([(1, TEXT), (2, None), (3, "")], "doc_id long, text string")
    got = [(r["kind"], ">".join(r["heading_path"]), r["text"]) for r in documents.markdown_blocks(df).orderBy("doc_id", "block_no").collect()]
    assert got == [
        ("heading", "Top", "Top"),
        ("paragraph", "Top", "Intro with bold and code going on."),
        ("list", "Top", "first point goes on"),
        ("list", "Top", "second"),
        ("heading", "Top>Part", "Part"),
        ("table", "Top>Part", "Name: a_b | Value: 1 | column 3: x"),
        ("table", "Top>Part", "Name: c"),
        ("heading", "Top>Part>Deep", "Deep"),
        ("paragraph", "Top>Part>Deep", "text"),
        ("heading", "Next", "Next"),
        ("paragraph", "Next", "last"),
    ]


def test_files_are_described_and_unknown_ones_refused(spark, tmp_path):
    (tmp_path / "a.md").write_text("# x")
    rows = documents.read_files(spark, str(tmp_path)).collect()
    assert [(r["suffix"], r["media_type"], len(r["sha256"])) for r in rows] == [("md", "text/markdown", 64)]
    with pytest.raises(documents.UnsupportedFormat, match="over 2 bytes"):
        documents.read_files(spark, str(tmp_path), most=2)
    (tmp_path / "b.pdf").write_text("x")
    with pytest.raises(documents.UnsupportedFormat, match="pdf"):
        documents.read_files(spark, str(tmp_path))


def test_exports_become_observations(spark, tmp_path):
    spans = [{"type": "workflow", "name": "Verify"}, {"type": "tool", "name": "check", "input": '{"pin": "1", "a": null}', "output": '{"status": "MATCH"}'}, {"type": "tool", "name": "put", "input": '{"policy_input": ["v", "7"]}', "output": "None"}, {"type": "llm", "name": "m"}]
    turns = [{"trace_name": "t", "spans": spans}, {"trace_name": "u", "spans": [{"type": "llm", "name": "m"}]}]
    (tmp_path / "e.json").write_text(json.dumps({"session_external_id": "c", "turns": turns}, indent=1))
    got = sorted((r["turn"], r["step"], r["kind"], r["name"], r["value"], len(r["arguments"])) for r in telemetry.read_exports(spark, str(tmp_path)).collect())
    assert got == [(0, 0, "capability", "Verify", None, 0), (0, 1, "outcome", "check", "MATCH", 0), (0, 1, "tool_call", "check", None, 2), (0, 2, "state_write", "v", "7", 0), (0, 2, "tool_call", "put", None, 1), (1, -1, "silence", "", None, 0)]


def test_catalogues_are_validated(spark):
    core = "relations:\n- {name: SAYS, domain: [A, B], range: [], literal_type: str, polarity: positive, not_checkable: true}\n"
    narrowed = catalogues.relations(core, "relations:\n- {name: SAYS, domain: [A]}\n- {name: NEW, domain: [A], range: [B], checks: {kind: k, dimension: d, scope: s, grouping: all}}\n")
    assert [r["name"] for r in narrowed] == ["SAYS", "NEW"] and narrowed[0]["domain"] == ["A"]
    assert catalogues.relation_frame(spark, narrowed).count() == 2
    for bad in ("relations:\n- {name: SAYS, domain: [C]}\n", "relations:\n- {name: N, domain: [A]}\n", "relations:\n- {name: N, literal_type: enum, not_checkable: true}\n"):
        with pytest.raises(catalogues.BadCatalogue):
            catalogues.relations(core, bad)
    assert catalogues.profile_frame(spark, "tools: {Tool x: wire}\n").collect()[0]["wire"] == "wire"
    levels, adverse = catalogues.factors("factors:\n- {name: a, levels: [1, 2], adverse: 2}\n- {name: b, levels: [x, y], invariant: false}\n")
    assert levels == {"a": ["1", "2"]} and adverse == {"a": "2"}
    with pytest.raises(catalogues.BadCatalogue):
        catalogues.factors("factors:\n- {name: a, levels: [1]}\n")


def test_graphs_are_read_as_they_were_written(spark, tmp_path):
    entities = spark.createDataFrame([("T:1", "Tool", "card_check", ["Card check", "card\ncheck"]), ("T:2", "Tool", "日本", None)], "entity_id string, entity_type string, canonical string, surfaces array<string>")
    triples = spark.createDataFrame([("T:1", "USES", "T:2", ["model"], "admitted", 9), ("T:2", "IS", 'say "x"', None, "review", 9)], "head string, relation string, tail string, methods array<string>, status string, extra int")
    path = str(tmp_path / "graph")
    for _ in range(2):  # writing again replaces what was there
        builds.write_graph(entities, triples, path)
    found, facts = builds.read_graph(spark, path)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, entities.collect()))
    assert sorted((r["head"], r["tail"], r["methods"], r["status"], r["spans"]) for r in facts.collect()) == [("T:1", "T:2", ["model"], "admitted", None), ("T:2", 'say "x"', None, "review", None)]
    (tmp_path / "graph" / "triples" / "part-x.json").write_text("not json\n")
    with pytest.raises(Exception, match="MALFORMED"):
        builds.read_graph(spark, path)[1].collect()


def test_quarantine_questions_and_manifest(spark, tmp_path):
    rows = spark.createDataFrame([(1, None), (2, "schema"), (3, "quote")], "id int, criterion string")
    builds.write_quarantine(rows, str(tmp_path / "q"))
    assert sorted((r["criterion"], r["id"]) for r in spark.read.json(str(tmp_path / "q")).collect()) == [("quote", 3), ("schema", 2)]
    builds.write_questions(rows.select("id"), rows.filter("id = 1"), str(tmp_path / "k"))
    assert spark.read.json(str(tmp_path / "k" / "questions")).count() == 3 and spark.read.json(str(tmp_path / "k" / "resolved")).count() == 1
    one, two = (builds.manifest(b=rows.repartition(k), a=rows.limit(0)).orderBy("name").collect() for k in (1, 3))
    assert one == two and [(r["name"], r["rows"]) for r in one] == [("a", 0), ("b", 3)] and one[0]["digest"] == "0" != one[1]["digest"]


def test_traces_of_payloads_of_any_shape(spark, tmp_path):
    spans = [
        {"type": "llm", "name": "m", "input": "[{'role': 'system', 'content': 's'}, {'role': 'user', 'content': \"it's me\"}]", "output": '{"role": "assistant", "content": ""}'},
        {"type": "tool", "name": "set_metadata", "input": '{"policy_input": ["checkpoint", "k14"]}', "output": "None", "step": 7},
        {"type": "tool", "name": "ask", "input": {"n": None, "b": True, "o": {"z": 1, "a": 2}}, "output": '{"code": 200, "response": {"status": "NO_MATCH"}}', "status_code": 200},
        {"type": "tool", "name": "set_metadata", "input": '{"policy_input": ["one"]}', "output": "nothing {"},
        {"type": "workflow", "name": "Verify", "input": "None"}, {"type": "odd"},
    ]
    turns = [{"trace_name": "abc:0", "trace_attributes": {"galileo_turn_id": "4"}, "spans": spans}, {"trace_name": "abc:1", "trace_attributes": {"galileo_turn_id": "x"}, "spans": [{"type": "llm", "input": None, "output": 7}]}, {"trace_name": "abc:2"}]
    (tmp_path / "a.json").write_text(json.dumps({"turns": turns}, indent=1))
    (tmp_path / "b.json").write_text("no json")
    (tmp_path / "c.json").write_text("[1]")
    got = [(r["seq"], r["turn"], r["step"], r["kind"], r["name"], r["value"], r["ref"], [tuple(a) for a in r["arguments"]]) for r in telemetry.read_traces(spark, str(tmp_path)).orderBy("seq").collect()]
    assert got == [
        (1, 4, 1, "utterance", "user", "it's me", "turn4.step1", []), (2, 4, 1, "assistant", "assistant", "", "turn4.step1", []), (3, 4, 7, "state_write", "checkpoint", "k14", "turn4.step7", []),
        (4, 4, 3, "tool_call", "ask", "200", "turn4.step3", [("b", "true"), ("n", ""), ("o", '{"a":2,"z":1}')]), (5, 4, 3, "outcome", "ask", "NO_MATCH", "turn4.step3", []),
        (6, 4, 4, "tool_call", "set_metadata", "", "turn4.step4", [("policy_input", '["one"]')]), (7, 4, 5, "capability", "Verify", "", "turn4.step5", []),
        (8, 1, 0, "silence", "", "no tool call in this turn", "turn1", []), (9, 2, 0, "silence", "", "no tool call in this turn", "turn2", []),
    ]
    assert {r["conversation_id"] for r in telemetry.read_traces(spark, str(tmp_path)).collect()} == {"abc"}


def zipped(path, **parts):
    with zipfile.ZipFile(path, "w") as book:
        for name, text in parts.items():
            book.writestr(name.replace("__", "/").replace("_x", "."), text)


def test_word_and_excel_files(spark, tmp_path):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    p = lambda t, s="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{s}{chr(34)}/></w:pPr>" if s else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    row = lambda *c: "<w:tr>" + "".join(f"<w:tc>{p(x)}</w:tc>" for x in c) + "</w:tr>"
    styles = f'<w:styles {w}><w:style w:styleId="T"><w:name w:val="Title"/></w:style><w:style w:styleId="H2"><w:name w:val="heading 2"/></w:style></w:styles>'
    body = p("Policy", "T") + p("  Intro   text ") + p("Part", "H2") + f"<w:tbl>{row('Name', '')}{row('a', 'b')}{row('', '')}</w:tbl>" + p("") + p("Next", "T") + p("end")
    zipped(tmp_path / "doc.docx", **{"word__styles_xxml": styles, "word__document_xxml": f"<w:document {w}><w:body>{body}</w:body></w:document>"})
    x, r = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"', 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    cells = '<row r="2"><c r="A2" t="s"><v>0</v></c><c r="C2" t="inlineStr"><is><t>On</t></is></c></row><row r="3"/><row r="5"><c r="A5"><v>3.0</v></c><c r="B5"><v>0.5</v></c><c r="C5" t="b"><v>1</v></c></row>'
    zipped(tmp_path / "book.xlsx", **{
        "xl__sharedStrings_xxml": f"<sst {x}><si><r><t>Li</t></r><r><t>mit</t></r></si></sst>", "xl__workbook_xxml": f'<workbook {x} {r}><sheets><sheet name="Main" r:id="r1"/><sheet name="Bare" r:id="r2"/></sheets></workbook>',
        "xl___rels__workbook_xxml_xrels": '<R><a Id="r1" Target="worksheets/s1.xml"/><a Id="r2" Target="/xl/worksheets/s2.xml"/></R>', "xl__worksheets__s1_xxml": f"<worksheet {x}><sheetData>{cells}</sheetData></worksheet>", "xl__worksheets__s2_xxml": f"<worksheet {x}/>",
    })
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "other.txt").write_text("x")
    rows = office.read_office(spark, str(tmp_path)).collect()
    mine = lambda name: [(r["location"], r["kind"], r["heading_path"], r["text"]) for r in sorted(rows, key=lambda r: r["block_no"] or 0) if r["path"].endswith(name)]
    assert mine("doc.docx") == [
        ("doc:Policy", "heading", ["Policy"], "Policy"), ("doc:Policy", "prose", ["Policy"], "Intro text"), ("doc:Policy > Part", "heading", ["Policy", "Part"], "Part"),
        ("doc:Policy > Part#table1r1", "table", ["Policy", "Part"], "Name: a | column 2: b"), ("doc:Next", "heading", ["Next"], "Next"), ("doc:Next", "prose", ["Next"], "end"),
    ]
    assert mine("book.xlsx") == [("book:sheet:Main!r5", "table", ["book", "Main"], "Limit: 3 | column 2: 0.5 | On: true")]
    assert [r["error"][:15] for r in rows if r["error"]] == ["can't be opened"] and len(rows) == 8


def test_canonical_files_are_the_same_however_the_rows_lie(spark, tmp_path):
    rows = spark.createDataFrame([(k % 7, f"é{k}", None if k % 3 else "x") for k in range(50)] + [(None, "first", None), (3, "é3", None)] * 2, "a int, b string, c string")
    for name, df in (("one", rows.coalesce(1)), ("many", rows.repartition(13, "b").withColumn("a", F.col("a")))):
        assert canonical.write_canonical(df, str(tmp_path / name), "-a", "b", rows_per_file=20) == 3
    read = lambda name: [(f.name, f.read_bytes()) for f in sorted((tmp_path / name).iterdir()) if not f.name.startswith(".")]
    assert read("one") == read("many") and [n for n, _ in read("one")] == [f"part-{k:08d}.jsonl" for k in range(3)]
    lines = [json.loads(x) for _, text in read("one") for x in text.decode().splitlines()]
    assert len(lines) == 54 and lines[0] == {"a": None, "b": "first", "c": None} and lines[2]["a"] == 6
    assert canonical.write_canonical(rows.limit(0), str(tmp_path / "one"), "a") == 0 and not read("one")


def test_compressed_files_have_the_same_lines(spark, tmp_path):
    rows = spark.range(50).select((F.col("id") % 7).alias("a"), F.concat(F.lit("é"), "id").alias("b"))
    for name, compressed in (("plain", False), ("small", True), ("again", True)):
        assert canonical.write_canonical(rows.repartition(3 if compressed else 5), str(tmp_path / name), "a", rows_per_file=20, compressed=compressed) == 3
    read = lambda name: {f.name: f.read_bytes() for f in (tmp_path / name).iterdir() if not f.name.startswith(".")}
    assert read("small") == read("again")
    assert {n: gzip.decompress(b) for n, b in read("small").items()} == {n + ".gz": b for n, b in read("plain").items()}


def test_states_go_on_with_and_without_a_library(monkeypatch):
    assert canonical._crypto() is not None  # a gigabyte would take over an hour without it
    for n in (0, 1, 55, 56, 63, 64, 65, 200, 5_000):
        data = bytes(k * 7 % 251 for k in range(n))
        for library in (canonical._crypto, lambda: None):
            with monkeypatch.context() as m:
                m.setattr(canonical, "_crypto", library)
                first = canonical.Sha256()
                first.update(data[: n // 3])
                second = canonical.Sha256(*first.state())
                second.update(data[n // 3 :])
                assert second.hexdigest() == hashlib.sha256(data).hexdigest()


def test_digests_of_sorted_lists_go_on_from_task_to_task(spark):
    values = ["", "b", "a" * 200, "é", "\U0001f600", "b", *(f"{k:04d}" for k in range(300))]
    df = spark.createDataFrame([(v,) for v in values] + [(None,)], "v string").repartition(9)
    want = hashlib.sha256("\x1f".join(sorted(values, key=str.encode)).encode()).hexdigest()
    assert canonical.ordered_digest(df, "v") == want
    assert canonical.ordered_digest(df.limit(0), "v") == hashlib.sha256(b"").hexdigest()
    files = spark.createDataFrame([("ff", "b.md"), ("00", "a.md")], "sha256 string, name string")
    assert canonical.corpus_hash(files) == hashlib.sha256(b"00:a.md\x1fff:b.md").hexdigest()[:16]
