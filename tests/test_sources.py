import hashlib
import io
import json
import lzma
import re
import zipfile

import pytest
from pyspark.sql import functions as F

from tidewright.operators import aggregates
from tidewright.sources import dumps, exports, html, loading, packs, sheets


def test_tuples_with_escapes_nulls_and_several_rows():
    found = list(dumps.parse_tuples(r"(1,'a\'b\\',NULL),(2,'x,(y)\n',-3);"))
    assert found == [["1", "a'b\\", None], ["2", "x,(y)\n", "-3"]]


def test_truncated_tuples_are_refused():
    with pytest.raises(ValueError):
        list(dumps.parse_tuples("(1,'a'),(2,'b"))


def test_sql_dump_is_read_by_statement(spark, tmp_path):
    path = tmp_path / "page.sql"
    path.write_text("CREATE TABLE `page` (x int);\nINSERT INTO `page` VALUES (1,0,'A_b',0,11,5),\n(2,0,'C\\'d',1,12,6);\nINSERT INTO `other` VALUES (9);\nINSERT INTO `page` VALUES (3,14,'E',0,NULL,7);\n")
    cols = ["page_id", "page_namespace", "page_title", "page_is_redirect", "page_latest", "page_len"]
    found = dumps.convert("page", dumps.read_sql_dump(spark, str(path), "page", cols)).orderBy("page_id").collect()
    assert [tuple(r) for r in found] == [(1, 0, "A_b", 0, 11, 5), (2, 0, "C'd", 1, 12, 6), (3, 14, "E", 0, None, 7)]


def test_dump_stages(spark):
    props = spark.createDataFrame([("1", "wikibase_item", "Q5"), ("2", "wikibase_item", "Q0"), ("3", "x", "Q1")], "pp_page string, pp_propname string, pp_value string")
    assert [tuple(r) for r in dumps.convert("page_props", props).collect()] == [(1, "Q5")]
    links = spark.createDataFrame([("1", "2", "https://org.example.www.", "/p"), ("2", "2", "mailto:x", None)], "el_id string, el_from string, el_to_domain_index string, el_to_path string")
    assert [r.target_url for r in dumps.convert("externallinks", links).collect()] == ["https://www.example.org/p"]
    legacy = spark.createDataFrame([("1", "Cat", None)], "cl_from string, cl_to string, cl_type string")
    assert [tuple(r) for r in dumps.convert("categorylinks", legacy).collect()] == [(1, "Cat", "")]
    with pytest.raises(ValueError):
        dumps.convert("nope", legacy)


def test_pages_of_an_xml_dump(spark, tmp_path):
    page = "<page><title>T{0}</title><ns>0</ns><id>{0}</id>{1}<revision><id>9{0}</id><text>body {0}</text></revision></page>"
    (tmp_path / "d.xml").write_text("<mediawiki>" + page.format(1, "") + page.format(2, '<redirect title="T1" />') + "</mediawiki>")
    found = dumps.read_pages_xml(spark, str(tmp_path / "d.xml")).orderBy("page_id").collect()
    assert [tuple(r) for r in found] == [(1, 0, "T1", 91, False, "body 1"), (2, 0, "T2", 92, True, "body 2")]


def test_bzip2_xml_is_read(spark, tmp_path):
    import bz2

    (tmp_path / "d.xml.bz2").write_bytes(bz2.compress(b"<m><page><title>T</title><ns>0</ns><id>1</id><revision><id>2</id><text>x</text></revision></page></m>"))
    assert dumps.read_pages_xml(spark, str(tmp_path / "d.xml.bz2")).count() == 1


def test_lexical_observations(spark):
    lines = [json.dumps({"word": " Ｆoo ", "lang_code": "EN_us", "pos": "noun", "senses": [{"a": 1}, {}], "forms": []}), "not json", json.dumps({"word": " "})]
    found = dumps.observations(spark.createDataFrame([(x,) for x in lines], "value string"), "jsonl").collect()
    assert [(r.language_code, r.lemma, r.lemma_key, r.senses) for r in found] == [("en-us", "Foo", "foo", 2)]
    lexeme = json.dumps({"id": "L7", "lexicalCategory": "Q1", "lemmas": {"de": {"value": "Straße"}, "aa": {"value": " "}}, "forms": [{}], "senses": []}) + ","
    found = dumps.observations(spark.createDataFrame([("[",), (lexeme,)], "value string"), "lexeme").collect()
    assert [(r.language_code, r.lemma, r.lemma_key, r.external_id) for r in found] == [("de", "Straße", "strasse", "L7")]
    tsv = spark.createDataFrame([("go\twent\tV;PST",), ("go\t\tV",), ("a\tb",)], "value string")
    assert [(r.lemma, r.pos) for r in dumps.observations(tsv, "tsv", language="en").collect()] == [("go", "V")]


def test_record_jar(spark, tmp_path):
    (tmp_path / "r").write_text("File-Date: 2020\n%%\nType: language\nSubtag: aa\nDescription: A\nDescription: B\n%%\nType: script\nComments: long\n  text\n")
    found = [r.fields for r in dumps.record_jar(spark, str(tmp_path / "r")).collect()]
    assert {"Type": "language", "Subtag": "aa", "Description": "A; B"} in found and {"Type": "script", "Comments": "long text"} in found


def test_turtle(spark, tmp_path):
    (tmp_path / "t.ttl").write_text('@prefix s: <http://s#> .\n@prefix x: <http://x/> .\n# note\nx:a a s:Concept ; s:prefLabel "A; b."@en , "Ä"@de ; s:broader x:b .\nx:b s:note "n\\"q" .\n')
    triples = dumps.read_turtle(spark, str(tmp_path / "t.ttl"))
    assert triples.count() == 5
    labels = dumps.labels_by_language(triples, "http://s#prefLabel").first()
    assert labels.s == "http://x/a" and labels.labels == {"en": ["A; b."], "de": ["Ä"]}


def test_zip_members(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("x.tsv", "1\n2\n")
        z.writestr("y.csv", "3\n")
        z.writestr("w.xz", lzma.compress(b"4\n5"))
    files = spark.read.format("binaryFile").load(str(tmp_path / "a.zip"))
    members = loading.archive_members(files)
    assert {(r.member, r["size"]) for r in members.collect()} >= {("x.tsv", 4), ("y.csv", 2)}
    wanted = members.filter("member <> 'y.csv'").withColumn("format", F.substring_index("member", ".", -1))
    assert [(r.member, r.format, r.line_no, r.line) for r in loading.member_lines(files, wanted).orderBy("member", "line_no").collect()] == [("w.xz", "xz", 1, "4"), ("w.xz", "xz", 2, "5"), ("x.tsv", "tsv", 1, "1"), ("x.tsv", "tsv", 2, "2")]


def test_packs_round_trip_and_refusals():
    data = packs.zip_pack({"a.txt": b"1", "b.txt": b"2"})
    assert packs.zip_pack({"b.txt": b"2", "a.txt": b"1"}) == data and packs.verify_pack(data) == []
    assert set(packs.read_reply(data)) == {"manifest.json", "a.txt", "b.txt"}
    with pytest.raises(ValueError):
        packs.read_reply(packs.zip_pack({"../x": b""}))
    with pytest.raises(ValueError):
        packs.read_reply(packs.zip_pack({f"{i}": b"" for i in range(30)}))


def test_canonical_json_and_keys():
    assert packs.canonical({"b": 1.0, "a": ["é", None, True]}) == '{"a":["é",null,true],"b":1}'
    with pytest.raises(ValueError):
        packs.canonical(float("nan"))
    fact = {"page_id": 1, "statement": "s", "source_quote": "q"}
    assert packs.fact_key(fact) == packs.fact_key(fact | {"source_quote": "other"}) != packs.fact_key(fact | {"statement": "t"})


def test_export_and_links(spark, tmp_path):
    df = spark.createDataFrame([(1, "en"), (2, "de"), (3, "en")], "a int, lang string")
    written = packs.export_jsonl(df, str(tmp_path / "out"), "lang").agg(F.sum("lines")).first()[0]
    assert written == 3
    text = (
        '<div class="navbox x"><br><img src="i"><a href="/x">n</a><a href="http://n">n</a></div><ol><li id="cite_note-1"><p><a href="http://c">c</a><a href="/own">o</a></p></li></ol>'
        '<li id="other"><a href="https://b">b</a></li><a href="/y">i</a><a href="https://own.org/z">i</a><span class="toc"><a href="http://t">t</a></span><a>none</a>'
    )
    page = spark.createDataFrame([(1, text), (2, None)], "page_id long, html string")
    found = [(r.href, r.context) for r in html.page_links(page, "page_id", "html", ("own.org",)).orderBy("position").collect()]
    assert found == [("/x", "navigation"), ("http://n", "navigation"), ("http://c", "citation"), ("/own", "internal"), ("https://b", "body"), ("/y", "internal"), ("https://own.org/z", "internal"), ("http://t", "navigation")]


def test_wikitext(spark):
    texts = ["[[foo_bar|x]] [[File:a]] [[foo bar#s]] [[&amp;b]] [[#s]] [[/sub]] [[ é  x ]]", " ".join(f"[[p{i}]]" for i in range(10)), None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert {r.i: r.a for r in rows.select("i", html.wiki_links("t", 4).alias("a")).collect()} == {0: ["Foo bar", "&b", "É x"], 1: ["P0", "P3", "P6", "P9"], 2: []}
    assert html.plain_lead_text("[[File:a.jpg|thumb|A [[cap]] here]]Lead [[Image:x|y]]text[[Category:Z]].") == "Lead text ."
    assert html.plain_lead_text("{{a|{{b}}}}'''X''' is [[y|z]].<ref>r</ref>\n== H ==\nrest") == "X is z."
    assert [s["title"] for s in html.sections("lead\n== A ==\nb c\n=== B ===\nd")] == ["", "A", "B"]
    assert html.passages("the cat " * 200, ["cat"], 2)[0].startswith("the cat")


def test_numbers_of_canonical_json():
    # The samples of RFC 8785, appendix B, and the borders of each notation.
    cases = [(1e-7, "1e-7"), (1e20, "100000000000000000000"), (1e21, "1e+21"), (0.000001, "0.000001"), (-0.0, "0"), (5e-324, "5e-324"), (1.7976931348623157e308, "1.7976931348623157e+308"), (9007199254740994.0, "9007199254740994"), (295147905179352830000.0, "295147905179352830000"), (333333333.33333329, "333333333.3333333"), (-1.5, "-1.5")]
    assert [packs.canonical(x) for x, _ in cases] == [y for _, y in cases]


def test_values_with_raw_line_ends(spark, tmp_path):
    rows = [(i, f"a;\n{i}\\' (x), ;\n") for i in range(2000)]
    text = "CREATE TABLE `page` (x int);\n" + "".join("INSERT INTO `page` VALUES " + ",".join("(%d,'%s')" % (i, v.replace("\\", "\\\\").replace("'", "\\'")) for i, v in rows[k : k + 500]) + ";\n" for k in range(0, 2000, 500))
    import gzip

    (tmp_path / "page.sql.gz").write_bytes(gzip.compress(text.encode()))
    found = dumps.read_sql_dump(spark, str(tmp_path / "page.sql.gz"), "page", ["id", "t"])
    assert sorted((int(r.id), r.t) for r in found.collect()) == rows
    (tmp_path / "cut.sql").write_text(text[:-40])
    with pytest.raises(Exception, match="cut off"):
        dumps.read_sql_dump(spark, str(tmp_path / "cut.sql"), "page", ["id", "t"]).collect()


def test_loads_go_on_and_refuse_changed_sources(spark, tmp_path):
    source, store = tmp_path / "source", str(tmp_path / "store")
    source.mkdir()
    write = lambda n, t: (source / n).write_text(t)
    write("a.csv", "1\n2\n")
    write("b.csv", "3\n")
    read = lambda path: spark.read.schema("x int").option("mode", "FAILFAST").csv(path)
    files = lambda: loading.listing(spark, str(source))
    done = loading.load_stage(spark, files(), "page", store, read)
    assert sorted((r.path.rsplit("/", 1)[1], r.rows, len(r.sha256)) for r in done.collect()) == [("a.csv", 2, 64), ("b.csv", 1, 64)]
    assert loading.load_stage(spark, files(), "page", store, read).count() == 2  # complete
    write("c.csv", "4\nbroken,row,x\n")
    with pytest.raises(Exception):  # noqa: B017 - what the reader raises
        loading.load_stage(spark, files(), "page", store, lambda p: read(p).filter(F.raise_error(F.lit("truncated")).isNull()))
    assert sorted(r.x for r in loading.loaded(spark, "page", store).collect()) == [1, 2, 3]
    write("c.csv", "4\n")
    assert loading.load_stage(spark, files(), "page", store, read).count() == 3
    assert sorted(r.x for r in loading.loaded(spark, "page", store).collect()) == [1, 2, 3, 4]
    write("b.csv", "3\n5\n")
    with pytest.raises(ValueError, match="changed"):
        loading.load_stage(spark, files(), "page", store, read)
    write("b.csv", "")
    with pytest.raises(ValueError):
        loading.load_stage(spark, files(), "other", store, read)


def test_sources_are_found_once(spark, tmp_path):
    for name in ("lex/kaikki/raw/en/d.jsonl.gz", "lex/unimorph/deu.zip", "lex/unimorph/readme.zip", "lex/wikidata/lexemes.json.bz2"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("x")
    rules = [("kaikki", r"lex/kaikki/raw/([^/]+)/[^/]+\.jsonl\.gz", "$1"), ("unimorph", r"lex/unimorph/([a-z]{3})\.zip", "$1"), ("wikidata", r"lex/wikidata/.*lexeme.*\.json\.bz2", "lexemes")]
    files = loading.listing(spark, str(tmp_path))
    found = loading.discovered(files.unionByName(files), str(tmp_path), rules)
    assert sorted((r.kind, r.edition) for r in found.collect()) == [("kaikki", "en"), ("unimorph", "deu"), ("wikidata", "lexemes")]
    first = loading.fingerprint(files)
    assert first == loading.fingerprint(files.repartition(3)) and not loading.new_epoch(first, first, spark.range(0))
    jobs = spark.createDataFrame([("READY",)], "status string")
    with pytest.raises(ValueError):
        loading.new_epoch(first, "old", jobs)
    assert loading.new_epoch(first, "old", jobs.limit(0))


def test_members_of_multistream_dumps(spark, tmp_path):
    import bz2

    parts = [bz2.compress(f"<page><id>{i}</id></page>".encode()) for i in range(4)]
    (tmp_path / "d.bz2").write_bytes(b"".join(parts))
    starts = [sum(map(len, parts[:i])) for i in range(4)]
    index = spark.createDataFrame([(f"{starts[i]}:{i}:T:{i}",) for i in range(4)] + [(f"{starts[1]}:9:same",)], "value string")
    members = loading.member_offsets(index, sum(map(len, parts)))
    assert sorted((r.page_id, r.title, r.start, r["size"]) for r in members.collect()) == sorted([*((i, f"T:{i}", starts[i], len(parts[i])) for i in range(4)), (9, "same", starts[1], len(parts[1]))])
    text = loading.read_members(members.filter("page_id in (2, 9)"), f"file://{tmp_path}/d.bz2")
    assert sorted(r.text for r in text.collect()) == ["<page><id>1</id></page>", "<page><id>2</id></page>"]


def test_entities_of_snapshots(spark, tmp_path):
    import gzip

    (tmp_path / "part-0.jsonl.gz").write_bytes(gzip.compress(b'{"id":"Q1","x":1}\n{"id":"P1"}\n\nno\n{"id":"Q2"},\n'))
    (tmp_path / "snapshot-manifest.json").write_text(json.dumps({"parts": [{"file": "part-0.jsonl.gz"}]}))
    lines = spark.read.text(loading.entity_files(spark, str(tmp_path))).select(F.col("value").alias("line"))
    assert sorted(r.qid for r in loading.entities(lines).collect()) == ["Q1", "Q2"]
    assert [r.qid for r in loading.entities(lines, spark.createDataFrame([("Q2",)], "qid string")).collect()] == ["Q2"]
    (tmp_path / "snapshot-manifest.json").write_text(json.dumps({"parts": [{"file": "../x"}]}))
    with pytest.raises(ValueError):
        loading.entity_files(spark, str(tmp_path))


def branch(tmp_path, **changes):
    spec = {"branch_id": "b1", "vocabulary": "v", "concepts_file": "c.json", "crosswalk_file": "x.json", "bridges_file": "b.csv", "discovery": {"auto_exact_category_roots": True, "auto_root_depth": 1, "max_reviewed_root_depth": 2, "max_category_tasks": 10, "max_members_per_category": 50}}
    files = {"concepts": [{"unesco_id": "concept1", "preferred_labels": {"en": ["A"]}, "broader": []}, {"unesco_id": "concept2", "preferred_labels": {}, "broader": ["concept1"]}], "bridges": "concept1,Trees of life,ACTIVE_REVIEWED_AI,a long enough reason,2\nconcept2,Other trees,PROPOSED_NOT_ACTIVE,,9\n"}
    spec, files = spec | changes.pop("spec", {}), files | changes
    (tmp_path / "branch.json").write_text(json.dumps(spec))
    (tmp_path / "c.json").write_text(json.dumps({"concepts": files["concepts"]}))
    (tmp_path / "x.json").write_text(json.dumps({"mappings": [{"mapping_id": "wd-p3916-concept1", "status": "candidate", "external_ref": {"system": "wikidata", "id": "Q5"}}, {"mapping_id": "wd-p3916-concept9", "status": "candidate", "external_ref": {"system": "wikidata", "id": "Q6"}}, {"mapping_id": "x", "status": "candidate", "external_ref": {}}]}))
    (tmp_path / "b.csv").write_text("concept_id,category_title,status,justification,depth_limit\n" + files["bridges"])
    return str(tmp_path)


@pytest.mark.parametrize(
    "changes",
    [
        {"spec": {"branch_id": "../x"}},
        {"spec": {"discovery": {"auto_exact_category_roots": True, "auto_root_depth": 9}}},
        {"spec": {"concepts_file": "../c.json"}},
        {"concepts": []},
        {"concepts": [{"unesco_id": "a"}, {"unesco_id": "a"}]},
        {"bridges": "concept7,Trees,PROPOSED_NOT_ACTIVE,,1\n"},
        {"bridges": "concept1,Trees,MAYBE,,1\n"},
        {"bridges": "concept1,Trees,ACTIVE_REVIEWED_AI,short,1\n"},
        {"bridges": "concept1,Trees,ACTIVE_REVIEWED_AI,a long enough reason,3\n"},
        {"bridges": "concept1,Trees,PROPOSED_NOT_ACTIVE,,1\nconcept1,Trees,PROPOSED_NOT_ACTIVE,,1\n"},
    ],
)
def test_branches_that_break_a_rule_are_refused(spark, tmp_path, changes):
    with pytest.raises(ValueError):
        loading.read_branch(spark, branch(tmp_path, **changes))


def test_branches_are_read(spark, tmp_path):
    found = loading.read_branch(spark, branch(tmp_path))
    assert found["concepts"].count() == 2 and [tuple(r) for r in found["qids"].collect()] == [("concept1", "Q5")]
    assert [(r.concept_id, r.depth) for r in found["bridges"].collect()] == [("concept1", 2)]


def test_exports_appear_whole(spark, tmp_path):
    tables = {"CLAIMS": (spark.createDataFrame([(2, "b"), (1, None)], "k int, v string"), ["k"])}
    info = exports.snapshot(tables, str(tmp_path / "s"), 3)
    assert info["rows"] == {"CLAIMS": 2} and info["facts"] == {"version": 3}
    assert spark.read.text(str(tmp_path / "s/0000000003/CLAIMS")).first()[0] == '{"k":1,"v":null}'
    assert exports.snapshot(tables, str(tmp_path / "s"), 3) == info  # there already
    assert [r.k for r in exports.read_latest(spark, str(tmp_path / "s"), "CLAIMS", "k int").orderBy("k").collect()] == [1, 2]
    part = next((tmp_path / "s/0000000003/CLAIMS").glob("part-*"))
    part.write_text(part.read_text() + "x")
    for crc in (tmp_path / "s/0000000003/CLAIMS").glob(".*.crc"):
        crc.unlink()
    with pytest.raises(ValueError, match="manifest"):
        exports.verify_export(spark, str(tmp_path / "s/0000000003"))


def test_parts_of_packs_are_bounded(spark):
    files = spark.createDataFrame([("p", f"f{i:04d}", "x" * (i % 90)) for i in range(500)] + [("q", "one", "y" * 5000)], "pack string, name string, text string")
    planned = packs.planned_packs(files, "pack", "name", "text", most_files=20, most_bytes=1000)
    sizes = planned.groupBy("pack", "part").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("b"), F.min("name").alias("a"), F.max("name").alias("z")).collect()
    assert all(r.n <= 20 and (r.b <= 1000 or r.n == 1) for r in sizes) and sum(r.n for r in sizes) == 501
    spans = sorted((r.a, r.z) for r in sizes if r["pack"] == "p")
    assert all(a[1] < b[0] for a, b in zip(spans, spans[1:]))
    made = packs.packed(files, "pack", "name", "text", 20, 1000)
    assert packs.verified_packs(made, ["pack", "part"]).count() == 0
    bad = made.withColumn("zip", F.concat("zip", F.lit(b"x")).substr(5, 100000))
    assert packs.verified_packs(bad, ["pack", "part"]).count() == made.count()


def test_guides_hold_verbatim_excerpts():
    text = "{{box}}\nThe lead has a line of prose with enough words in it.\n== Early life ==\n* list\nThis section tells of many things in some more words here.\n== References ==\nnot to be read at all by anyone who is in a hurry\n=== History of it ===\nHistory is told here in a line with enough words too.\n== Short ==\nfew words"
    found = html.guide(text, "history", "references?", words=5, most=1)
    assert found["samples"] == [{"section": "", "excerpt": "The lead has a line of prose with enough words in it."}, {"section": "History of it", "excerpt": "History is told here in"}]
    assert [(s["heading"], s["reference"], s["hint"]) for s in found["sections"]] == [("", False, False), ("Early life", False, False), ("References", True, False), ("History of it", False, True), ("Short", False, False)]
    assert sum(s["words"] for s in found["sections"]) == len(re.sub(r"(?m)^=.*=$", "", text).split())
    assert html.guide("{{x}}\ntwo words", "a", "b")["samples"] == [{"section": "", "excerpt": "two words"}] and html.guide("", "a", "b")["samples"] == []


def test_ordered_digests_follow_rows_and_order(spark):
    rows = spark.createDataFrame([(i, f"t{i * 7 % 5}") for i in range(2500)], "k int, v string")
    digest = lambda df, order: aggregates.ordered_digest(df, order, ["k", "v"], block=10).first()
    one = digest(rows, ["k"])
    assert one.n == 2500 and one == digest(rows.repartition(7), ["k"]) and one != digest(rows, ["v", "k"])
    assert one != digest(rows.withColumn("v", F.when(F.col("k") == 99, "x").otherwise(F.col("v"))), ["k"])
    level = [hashlib.sha256(json.dumps({"k": i, "v": f"t{i * 7 % 5}"}, separators=(",", ":")).encode()).hexdigest() for i in range(2500)]
    while len(level) > 1:
        level = [hashlib.sha256("".join(level[i : i + 10]).encode()).hexdigest() for i in range(0, len(level), 10)]
    assert one.sha256 == level[0] and digest(rows.limit(0), ["k"]).n == 0


def test_sheets_keep_text_numbers_and_gaps():
    rows = [(1, "a <&> \"b\"\n c", None), (2.5, None, "x" * 40_000), (None, "=1+1", "é\x01")]
    data = sheets.write_workbook(["n", "t", "long"], rows, ("n",))
    assert list(sheets.read_workbook(data)) == [["n", "t", "long"], ["1", "a <&> \"b\"\n c", None], ["2.5", None, "x" * 40_000], [None, "=1+1", "é"]]
    assert [sheets.column_number(sheets.column_name(i)) for i in range(2000)] == list(range(2000)) and sheets.column_name(701) == "ZZ"
    shared = io.BytesIO()
    main = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    with zipfile.ZipFile(shared, "w") as z:
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{main}"><si><t>k</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{main}"><sheetData><row r="1"><c r="B1" t="s"><v>0</v></c></row><row r="2"><c r="B2" t="s"><v>1</v></c><c r="C2"><f>1+1</f><v>2</v></c></row></sheetData></worksheet>')
    assert list(sheets.read_workbook(shared.getvalue())) == [[None, "k"], [None, "two runs", "2"]]
