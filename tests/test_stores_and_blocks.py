import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.operators import fulltext, incremental, registry, retrieval, search, summary_blocks
from tessera.plans import build
from tessera.sources.sinks import Warehouse, read_synthesis, synthesis_row


@pytest.fixture()
def chunks(spark):
    texts = ["Read the file the file", "the File, a filename", None, "", "no such thing the", "fileless the fi", "THE FIle: the.file"]
    return spark.createDataFrame([(f"c{k}", t, "the file" if k % 2 else None) for k, t in enumerate(texts)], "id string, content string, title string")


@pytest.mark.parametrize("query", ["the file", "the fi", "file", "f", "the", "a filename", "", "nothing here"])
@pytest.mark.parametrize("clamp", [True, False])
def test_stored_index_answers_like_a_scan(spark, chunks, tmp_path, query, clamp):
    root = str(tmp_path / "index")
    fulltext.build(chunks, root, id_col="id", text_cols=["content", "title"])
    want = search.bm25(chunks, query, id_col="id", text_cols=["content", "title"], clamp=clamp)
    found = fulltext.bm25(spark, root, query, clamp=clamp)
    key = lambda r: (r["id"], r["matches"], r["length"], round(r["score"], 9))
    assert sorted(map(key, found.collect())) == sorted(map(key, want.collect()))


def test_index_reads_folders_of_its_words_and_forgets_rows(spark, chunks, tmp_path):
    root = str(tmp_path / "index")
    fulltext.build(chunks.where("id <> 'c6'"), root, id_col="id", text_cols=["content", "title"])
    fulltext.build(chunks.where("id = 'c6'"), root, id_col="id", text_cols=["content", "title"], mode="append")
    plan = fulltext.bm25(spark, root, "the file")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(head" in plan and "content" not in plan
    assert {r.id for r in fulltext.matches(spark, root, "the file").collect()} == {"c0", "c1", "c3", "c5", "c6"}
    fulltext.remove(spark, root, spark.createDataFrame([("c0",), ("c6",)], "id string"))
    assert {r.id for r in fulltext.matches(spark, root, "the file").collect()} == {"c1", "c3", "c5"}
    assert spark.read.parquet(f"{root}/totals").first()["docs"] == 5


def test_a_rare_head_is_one_file_however_large_the_index_is(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(fulltext, "POSTINGS_PER_TASK", 50)
    root = str(tmp_path / "index")
    texts = spark.createDataFrame([(f"c{k}", "common " * 10 + ("rare" if k % 3 == 0 else "")) for k in range(40)], "id string, content string")
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        fulltext.build(texts, root, id_col="id", text_cols=["content"])
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    files = lambda head: list((tmp_path / "index" / "postings" / f"head={head}").glob("*.parquet"))
    assert len(files("ra")) == 1 and len(files("co")) > 4
    assert {(r.id, r.matches) for r in fulltext.matches(spark, root, "common").collect()} == {(f"c{k}", 10) for k in range(40)}
    assert {r.id for r in fulltext.matches(spark, root, "common rare").collect()} == {f"c{k}" for k in range(0, 40, 3)}
    assert {r.length for r in spark.read.parquet(f"{root}/lengths").collect()} == {10, 11}


def test_blocks_are_read_as_they_are_written():
    block = """# a comment
file_summary:
  purpose: "says: it's \\"fine\\""
  layer: api   # of the list
  key_abstractions:
    - One
    - 'Two, too'
  internal_deps: [a.py, "b, c.py", 'd']
  external_deps: []
  notes: >
    folded
    text
  issues:
  - title: first
    lines: [3, 9]
  -
    title: second
    category: security
    severity: problem
    line_start: 1
    line_end: 2
  - just text
"""
    found = summary_blocks.read_block(block)["file_summary"]
    assert found["purpose"] == "says: it's \"fine\"" and found["layer"] == "api" and found["notes"] == "folded text"
    assert found["key_abstractions"] == ["One", "Two, too"] and found["internal_deps"] == ["a.py", "b, c.py", "d"] and found["external_deps"] == []
    assert [x["title"] if isinstance(x, dict) else x for x in found["issues"]] == ["first", "second", "just text"]
    for broken in ("a: 1\n   b: 2", "\tx: 1", "a: 1\nplain", "{ x"):
        with pytest.raises(ValueError):
            summary_blocks.read_block(broken)
    assert summary_blocks.read_block("\n# nothing\n") is None


def test_summaries_of_pages(spark):
    block = "---\nfile_summary:\n  purpose: P\n  layer: domain\n  issues:\n    - title: t\n      category: odd\n      severity: problem\n---\n"
    rows = spark.createDataFrame([("a", "x\n" + block + "y\n"), ("b", "no block"), ("c", None), ("d", "---\nfile_summary: text\n---\nz"), ("e", block + "one\n" + block)], "file_path string, content string")
    found = {r.file_path: r for r in summary_blocks.file_summaries(rows).collect()}
    assert (found["a"].purpose, found["a"].layer, found["a"].content) == ("P", "domain", "x\ny")
    assert [(i.category, i.severity, i.line_start) for i in found["a"].issues] == [("maintainability", "problem", None)]
    assert all((found[k].purpose, found[k].layer) == ("Unknown", "utility") for k in "bcd") and found["d"].content == "---\nfile_summary: text\n---\nz"
    assert found["c"].content is None and found["e"].content == "one"


def test_registry_and_settings(spark):
    new = spark.createDataFrame([("u1", "git", "/a", "A"), ("u2", "git", "/b", "B"), ("u1", "git", "/c", "C")], "origin_url string, source_type string, local_path string, display_name string")
    repos = registry.add_repos(schemas.empty(spark, "repos"), new, F.lit("2026-01-01").cast("timestamp"))
    repos = registry.add_repos(repos, new.limit(1).withColumn("origin_url", F.lit("u3")), F.lit("2026-01-02").cast("timestamp"))
    assert [(r.id, r.origin_url, r.status) for r in registry.list_repos(repos).collect()] == [(1, "u1", "pending"), (2, "u2", "pending"), (3, "u3", "pending")]
    repos = registry.update_repo(repos, 2, status="ready", id=7, origin_url="x", head_commit="abc")
    assert [(r.id, r.origin_url, r.status, r.head_commit) for r in registry.get_repo(repos, 2).collect()] == [(2, "u2", "ready", "abc")]
    assert registry.find_by_url(registry.delete_repo(repos, 1), "u1").count() == 0
    settings = registry.set_settings(schemas.empty(spark, "settings"), spark.createDataFrame([("active_repo_id", "1", 1), ("active_repo_id", "2", 2), ("x", "y", 1)], "key string, value string, seq bigint"))
    assert registry.get_setting(settings, "active_repo_id").first()["value"] == "2"
    assert registry.active_repo(settings, repos).first()["id"] == 2
    assert registry.active_repo(registry.delete_settings(settings, settings.select("key").limit(9)), repos).count() == 0


JOB = "id string, type string, status string, started_at timestamp"


def test_full_and_incremental_builds(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "base"))
    job = lambda k: spark.createDataFrame([(k, "full", "running", None)], JOB)
    files = spark.createDataFrame([("a/x.py", 40, b"import b\n\ndef main():\n    helper()\n\ndef helper():\n    return 1\n"), ("a/y.min.js", 3, b"x"), ("b.py", 5, b"V = 1\n")], "path string, length bigint, content binary")
    assert build.choose_mode(store) == "full"
    assert build.run(spark, store, files, job("j1")).count() == 0
    assert {r.name for r in store.read("symbols").collect()} >= {"main", "helper"} and store.read("edges").count() == 1
    assert not store.incomplete()
    pages = schemas.empty(spark, "pages").select("*")
    made = spark.createDataFrame([("p1", "file", "a/x.py"), ("p2", "file", "gone.py"), ("p3", "workflow", None), ("p4", "file", None)], "path string, type string, target string")
    store.write(pages.unionByName(schemas.conform(made, "pages")), "pages")
    notes = spark.createDataFrame([("file", "gone.py", "n"), ("file", "b.py", "n"), ("general", "", "n")], "scope string, target string, content string")
    store.write(schemas.conform(notes, "notes"), "notes")
    assert build.choose_mode(store) == "incremental" and build.choose_mode(store, "full") == "full"
    counts = {r.type: r.deleted for r in build.run(spark, store, files, job("j2")).collect()}
    assert counts == {"file": 1, "workflow": 1, "note": 1}
    assert sorted(r.path for r in store.read("pages").collect()) == ["p1", "p4"] and store.read("notes").count() == 2
    assert sorted(r.id for r in store.read("jobs").collect()) == ["j1", "j2"]
    build.run(spark, store, files, job("j3"), wanted="full")
    assert store.read("pages").count() == 0 and [r.id for r in store.read("jobs").collect()] == ["j3"]
    with pytest.raises(ValueError):
        build.begin(store, "some", job("j4"))


def test_a_stopped_swap_loses_nothing(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "base"))
    store.write(spark.range(3), "t")
    path = f"{store.live}/t"
    fs, p = store._fs(path)
    fs.rename(p, store._fs(f"{path}__old")[1])  # as if stopped after the first move
    assert store.read("t").count() == 3
    store.write(spark.range(4), "t")
    assert store.read("t").count() == 4 and not store.exists(f"{path}__old")


def test_embedding_model_and_synthesis_round_trip(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "base"))
    assert store.embedding_model().count() == 0
    store.save_embedding_model("p", "m")
    assert incremental.mismatch(store.embedding_model(), "p", "other").first()[0] and not incremental.mismatch(store.embedding_model(), "p", "m").first()[0]
    store.forget_embedding_model()
    assert store.embedding_model().count() == 0
    parts = spark.createDataFrame([([("api", ["a.py"])], {"files": 3})], "layers array<struct<name:string,files:array<string>>>, metrics map<string,int>")
    row = synthesis_row(parts)
    ddl = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in parts.schema)
    assert read_synthesis(row, ddl).collect() == parts.collect()
    assert read_synthesis(row.withColumn("hash", F.lit("0")), ddl).count() == 0


def test_answers_in_both_forms_are_read_alike():
    assert retrieval.read_response("<answer> A b </answer>\n<missing>\n- x::y\n* NONE\n</missing>") == ("A b", ["x::y", "* NONE"])
    assert retrieval.read_response("ANSWER: It is so.\nMISSING (or NONE):\n- the cache\n-- a in b.py\n") == ("It is so.", ["the cache", "a in b.py"])
    assert retrieval.read_response("plain words") == ("plain words", []) and retrieval.read_response("ANSWER: x\nMISSING: NONE")[1] == []


def test_undecodable_bytes_go_and_real_replacement_characters_stay(spark):
    from tessera.sources.files import lossy_text

    rows = spark.createDataFrame([(bytearray(b"a\xff\xef\xbf\xbdb\xc3"),), (bytearray("é".encode()),), (None,)], "c binary")
    assert [r[0] for r in rows.select(lossy_text(F.col("c"))).collect()] == ["a�b", "é", None]
