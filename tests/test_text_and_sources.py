"""Chunking against a line-by-line model, sources, contracts and sinks."""

import json
import random
import re

import pytest
from pyspark.sql import functions as F

from graphloom import contracts
from graphloom.functions import text as tx
from graphloom.operators import chunking as C
from graphloom.sources import files, sinks


def tokens(s):
    return max(1, len(s.split()) * 4 // 3)


def model_blocks(lines):
    out, cur, state = [], [], "N"

    def flush():
        if "\n".join(cur).strip():
            out.append("\n".join(cur).strip())
        cur.clear()

    for line in lines:
        if not line.strip():
            if state == "N":
                flush()
            else:
                cur.append(line)
            state = "N"
        elif line.strip().startswith("|"):
            if state == "N":
                flush()
            cur.append(line)
            state = "T"
        elif re.match(r"\s*[-*+]\s+|\s*\d+[.)]\s+", line):
            cur.append(line)
            state = "L"
        elif state != "N" and line[0] in " \t":
            cur.append(line)
        else:
            if state != "N":
                flush()
            cur.append(line)
            state = "N"
    flush()
    return out


def model_pack(blocks, most, overlap):
    chunks, cur = [], []

    def close():
        chunks.append(list(cur))
        tail, n = [], 0
        for b in reversed(cur):
            if n >= overlap and tail:
                break
            tail.insert(0, b)
            n += tokens(b)
        cur[:] = tail

    for b in blocks:
        if cur and sum(map(tokens, cur)) + tokens(b) > most:
            close()
        cur.append(b)
        if sum(map(tokens, cur)) >= most:
            close()
    return chunks + ([list(cur)] if cur else [])


def model_chunks(doc, text, most, overlap):
    sections, path = [([], [])], []
    for line in text.split("\n"):
        m = re.match(r"(#{1,6})\s+(.*)$", line, re.S)
        if m:
            level = len(m[1])
            path = [*path[: level - 1], *[""] * (level - 1 - len(path)), m[2].strip()]
            sections.append((list(path), []))
        else:
            sections[-1][1].append(line)
    out = []
    for p, lines in sections:
        for c in model_pack(model_blocks(lines), most, overlap):
            content = "\n\n".join(c).strip()
            out.append((f"{doc}_chunk_{len(out):04d}", doc, " > ".join(x for x in p if x) or doc, content, tokens(content)))
    return out


def test_chunks_equal_the_model(spark):
    rnd = random.Random(6)
    bits = ["# Top", "## Sub part", "#### Deep", "####### no", "plain words here", "more words, and more", "- item", "  indented", "1. first", "| a | b |", "|---|", "", "", " ", "w " * 30]
    docs = [(f"d{i}", "\n".join(rnd.choice(bits) for _ in range(rnd.randrange(1, 40)))) for i in range(80)] + [("null", None), ("empty", "")]
    df = spark.createDataFrame([(*d, "x") for d in docs], "document_id string, markdown string, line string")
    for most, overlap in ((800, 100), (30, 10)):
        got = {tuple(r) for r in C.chunk_documents(df, max_tokens=most, overlap_tokens=overlap).collect()}
        assert got == {c for d, t in docs if t is not None for c in model_chunks(d, t, most, overlap)}
    assert C.chunk_documents(df.limit(0)).count() == 0
    assert C.chunk_documents(df, min_tokens=10).where("token_count < 10").count() == 0


def test_giant_block_is_its_own_overlap(spark):
    df = spark.createDataFrame([("g", "w " * 700)], "document_id string, markdown string")
    assert [r.token_count for r in C.chunk_documents(df).orderBy("chunk_id").collect()] == [933, 933]


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} string" for k in values))
    return df.select(column.alias("x")).first().x


def test_text_functions(spark):
    c = F.col("s")
    assert one(spark, tx.slug(c), s=" Foo-Bar  System! ") == "foo_bar_system"
    assert len(one(spark, tx.slug(c), s="日本")) == 8
    assert one(spark, tx.entity_id(F.lit("API"), c), s="A.b") == "entity_api_a_b"
    assert one(spark, tx.title_case(c), s="it's my-file 3rd") == "It'S My-File 3Rd"
    assert one(spark, tx.sentences(c), s=" One.  Two!\nThree? four ") == ["One.", "Two!", "Three?", "four"]
    assert one(spark, tx.occurrences(c, F.lit("aa")), s="aaaa baa") == [0, 2, 6]
    assert one(spark, tx.occurrences(c, F.lit("a.")), s="xay") == []
    assert one(spark, tx.snippet(c), s="  a\nb " + "c" * 300) == "a b " + "c" * 196
    assert one(spark, tx.token_count(c), s="") == 1 and one(spark, tx.token_count(c), s="a b c") == 4
    assert one(spark, tx.label_of(c), s="External Partner") == "ExternalPartner"


def test_page_text(spark):
    clean = files.clean_page(F.col("s"), F.col("t"))
    assert one(spark, clean, s="MAC12true Some   text\nMAC3false here Title ", t="Title") == "Some text here"
    assert one(spark, clean, s="abc", t="") == "abc"
    h = F.from_json(F.lit('[{"level":2,"text":"B"},{"text":"A"},{"level":1,"text":""},{"level":1,"text":"zz"}]'), "array<struct<level:int,text:string>>")
    assert one(spark, files.mark_headings(F.col("s"), h), s="A x B y B") == "\n\n# A\n\n x \n\n## B\n\n y B"
    assert one(spark, files.plain_to_markdown(F.col("s"), F.lit("my_file-name")), s="text") == "# My File Name\n\ntext"
    assert one(spark, files.plain_to_markdown(F.col("s"), F.lit("f")), s="\n # own") == "\n # own"


def test_page_tree_source(spark, tmp_path):
    def page(path, **over):
        p = tmp_path / "pages" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        base = {"page_id": p.stem, "title": "T" + p.stem, "space_key": "S", "version": 2, "content_hash": "h", "sanitized_text": "Intro Head body", "metadata": {"headings": [{"level": 2, "text": "Head"}]}, "is_deleted": False}
        p.write_text(json.dumps(base | over))

    page("1.json")
    page("1/2.json")
    page("1/3.json", is_deleted=True)
    rows = {r.document_id: r for r in files.page_documents(spark, str(tmp_path), "now").collect()}
    assert set(rows) == {"1", "2"} and rows["1"].parent_page_id is None and rows["2"].parent_page_id == "1"
    assert rows["1"].markdown == "# T1\n\nIntro \n\n## Head\n\n body" and rows["2"].version == 2


def test_folder_source_and_rejects(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a b.TXT").write_text("hello")
    (tmp_path / "c.md").write_text("# C")
    (tmp_path / "d.html").write_text("<html><script>x</script><h2>Hi</h2><p>one <b>two</b></p><ul><li>i</li></ul></html>")
    (tmp_path / "e.pdf").write_bytes(b"%PDF")
    (tmp_path / "skip.bin").write_bytes(b"x")
    good, bad = files.extract(spark, str(tmp_path), "now")
    found = {r.document_id: r.markdown for r in good.collect()}
    assert found == {"a b": "# A B\n\nhello", "c": "# C", "d": "## Hi\n\none two\n\n- i"}
    assert [r.error for r in bad.collect()] == ["no converter for pdf"]
    assert {r.document_id for r in files.folder_documents(spark, str(tmp_path), "now").collect()} == {"a b", "c", "d", "e"}
    more, none = files.extract(spark, str(tmp_path), "now", {"pdf": lambda b: "# P"})
    assert more.count() == 4 and none.count() == 0


def test_contracts(spark):
    assert contracts.identifier("a_1") == "a_1"
    for bad in ("a b", "a;drop", ""):
        with pytest.raises(ValueError):
            contracts.identifier(bad)
    assert contracts.create_table_sql("mentions") == "CREATE TABLE IF NOT EXISTS mentions (chunk_id string, entity_id string) USING parquet"
    assert sinks.merge_sql("mentions", "s").startswith("MERGE INTO mentions t USING s s ON t.chunk_id = s.chunk_id AND t.entity_id = s.entity_id WHEN NOT MATCHED")
    df = contracts.conform(spark.createDataFrame([("c", 1)], "chunk_id string, extra int"), "mentions")
    assert df.columns == ["chunk_id", "entity_id", "extra"] and df.first().entity_id is None
    rows = spark.createDataFrame([("a", "x"), ("a", "x"), (None, "x"), ("b", "x")], "chunk_id string, entity_id string")
    assert {(r.chunk_id, r.n_rows) for r in contracts.key_violations(rows, "mentions").collect()} == {("a", 2), (None, 1)}


def test_upserts(spark, tmp_path):
    root = str(tmp_path)
    assert files.read_table(spark, root, "entities").count() == 0
    schema = "id string, name string, type string, source_chunk string, n int"
    batch = lambda *rows: spark.createDataFrame([(i, v, "T", "c", k) for k, (i, v) in enumerate(rows)], schema)
    sinks.upsert(batch(("a", "1"), ("b", "1"), ("a", "2")), root, "entities", "n")
    sinks.upsert(batch(("b", "3"), ("c", "3")), root, "entities", "n")
    sinks.upsert(batch(("x", "9")).limit(0), root, "entities", "n")
    assert {(r.id, r.name) for r in files.read_table(spark, root, "entities").collect()} == {("a", "2"), ("b", "3"), ("c", "3")}
    own = files.read_table(spark, root, "entities")
    sinks.overwrite(own.where("id <> 'a'"), root, "entities")  # reads what it replaces
    assert files.read_table(spark, root, "entities").count() == 2
    paths = sinks.write_markdown_files(spark.createDataFrame([("d/1", "# x")], "document_id string, markdown string"), str(tmp_path / "md")).collect()
    assert open(paths[0].markdown_path).read() == "# x"
