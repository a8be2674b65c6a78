"""The index in segments, bucketed tables, migrations and builds that go on from where they were."""

import contextlib
import sqlite3

import pytest
from pyspark.sql import functions as F

from tessera import schemas
from tessera.functions import text as fn
from tessera.operators import segments
from tessera.operators.segments import SegmentedIndex
from tessera.params import DEFAULT
from tessera.plans import build, pages
from tessera.sources import migrations, sqlite
from tessera.sources.buckets import BucketTable
from tessera.sources.sinks import Warehouse
from tessera.sources.versions import Versions
from tessera.streaming import jobs


def chunks(spark, rows):
    """rows: {path: text or None}; one chunk each, none for None."""
    held = spark.createDataFrame([(p, f"{p}#0", t) for p, t in rows.items() if t is not None], "path string, chunk_id string, content string")
    owners = spark.createDataFrame([(p, str(hash(t))) for p, t in rows.items()], "path string, hash string")
    return held, owners


def ids(df):
    return sorted(r.id for r in df.collect())


def files_below(index, folder):
    fs, p = index.versions.path(f"{index.root}/{folder}")
    return {s.getPath().getName() for s in fs.listStatus(p)} if fs.exists(p) else set()


@pytest.fixture
def index(spark, tmp_path):
    return SegmentedIndex(spark, str(tmp_path / "index"), text_cols=("content",))


def test_updates_replace_and_remove_owners_without_touching_others(spark, index):
    index.update(*chunks(spark, {"a": "red apple", "b": "red brick", "c": None}))
    first = files_below(index, "postings")
    assert ids(index.matches("red")) == ["a#0", "b#0"] and index.owners().count() == 3
    index.update(*chunks(spark, {"b": "green grass"}), removed=spark.createDataFrame([("a",)], "path string"))
    assert files_below(index, "postings") > first and len(files_below(index, "postings")) == 2
    assert ids(index.matches("red")) == [] and ids(index.matches("gr")) == ["b#0"]
    assert sorted(r.owner for r in index.owners().collect()) == ["b", "c"]
    index.update(*chunks(spark, {"a": "red again"}))
    assert ids(index.matches("red")) == ["a#0"] and index.totals().first().docs == 2


def test_changes_are_what_the_index_does_not_hold(spark, index):
    index.update(*chunks(spark, {"a": "x", "b": "y"}))
    now = spark.createDataFrame([("a", str(hash("x"))), ("b", "other"), ("n", "1")], "path string, hash string")
    stale, gone = index.changes(now)
    assert sorted(r.path for r in stale.collect()) == ["b", "n"] and gone.count() == 0
    stale, gone = index.changes(now.where("path <> 'a'"))
    assert [r.path for r in gone.collect()] == ["a"]
    none, _ = chunks(spark, {"a": None})
    before = index.versions.read()[0]
    assert index.update(none, now.limit(0)) == before


def test_a_stop_before_the_commit_changes_nothing(spark, index, monkeypatch):
    index.update(*chunks(spark, {"a": "red apple"}))
    with monkeypatch.context() as m:
        m.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            index.update(*chunks(spark, {"a": "blue", "b": "red"}))
    assert ids(index.matches("red")) == ["a#0"] and ids(index.matches("blue")) == []
    assert len(files_below(index, "postings")) == 2
    index.vacuum()
    assert len(files_below(index, "postings")) == 1 and ids(index.matches("red")) == ["a#0"]
    index.update(*chunks(spark, {"a": "blue", "b": "red"}))
    assert ids(index.matches("red")) == ["b#0"]


def test_segments_merge_and_dead_rows_go(spark, index):
    for k in range(segments.FAN * 2 + 1):
        index.update(*chunks(spark, {f"p{k}": f"word{k} common", "same": f"turn{k} common"}))
    held = index.entries()["segments"]
    assert len(held) < segments.FAN * 2 and ids(index.matches("turn")) == ["same#0"]
    assert len(ids(index.matches("common"))) == segments.FAN * 2 + 2
    index.compact()
    assert len(index.entries()["segments"]) == 1 and index.entries()["tombstones"] == []
    assert len(ids(index.matches("common"))) == segments.FAN * 2 + 2 and ids(index.matches("turn8")) == ["same#0"]
    assert index.vacuum() > 0 and index.totals().first().docs == segments.FAN * 2 + 2


def test_a_merge_takes_over_full_folders_without_dead_rows(spark, index, monkeypatch):
    monkeypatch.setattr(segments, "POSTINGS_PER_TASK", 3)
    index.update(*chunks(spark, {"a": "red apple pie", "b": "red brick wall"}))
    index.update(*chunks(spark, {"c": "red car seat", "d": "red door bell", "n": None}))
    index.update(*chunks(spark, {"e": "red"}))
    full = [f"segment={s['name']}" for s in index.entries()["segments"]][:2]
    index.compact()
    index.vacuum()
    assert len(index.entries()["segments"]) == 1 and index.entries()["tombstones"] == []
    assert files_below(index, "postings") > set(full) and len(files_below(index, "postings")) == 3
    assert ids(index.matches("red")) == ["a#0", "b#0", "c#0", "d#0", "e#0"] and index.totals().first().docs == 5
    # An owner without chunks that is dead counts too: its tombstone goes with the merge.
    index.update(*chunks(spark, {"a": "green", "n": "red now"}))
    assert ids(index.matches("red")) == ["b#0", "c#0", "d#0", "e#0", "n#0"]
    index.compact()
    index.vacuum()
    assert not files_below(index, "postings") & set(full) and index.entries()["tombstones"] == []
    assert ids(index.matches("red")) == ["b#0", "c#0", "d#0", "e#0", "n#0"] and ids(index.matches("green")) == ["a#0"]
    assert sorted(r.owner for r in index.owners().collect()) == ["a", "b", "c", "d", "e", "n"]


def test_postings_are_not_shuffled_and_files_are_sorted_by_term(spark, index, monkeypatch):
    monkeypatch.setattr(segments, "POSTINGS_PER_TASK", 30)
    plans, write = [], SegmentedIndex._write_postings
    monkeypatch.setattr(SegmentedIndex, "_write_postings", lambda self, name, rows: (plans.append(rows._jdf.queryExecution().optimizedPlan().toString()), write(self, name, rows))[1])
    index.update(*chunks(spark, {f"p{k}": " ".join(f"w{(k * j) % 17} common" for j in range(10)) for k in range(30)}))
    assert plans[0].index("Generate") < plans[0].index("Repartition")
    rows = index._read("postings", segments._POSTINGS, index.entries()["segments"]).select(F.input_file_name().alias("file"), "term", "id").collect()
    files = {}
    for r in rows:
        files.setdefault(r.file, []).append(r)
    assert len(files) > 5 and all([r.term for r in held] == sorted(r.term for r in held) for held in files.values())
    assert sum(len({r.id for r in held}) for held in files.values()) == 30
    assert {r.length for r in index._read("lengths", segments._LENGTHS, index.entries()["segments"]).collect()} == {20} and len(ids(index.matches("common"))) == 30


def test_two_writers_do_not_overwrite_each_other(spark, tmp_path):
    versions = Versions(spark, str(tmp_path / "v"))
    assert versions.read() == (0, {})
    assert versions.commit(0, {"a": 1}) == 1
    with pytest.raises(RuntimeError):
        versions.commit(0, {"a": 2})
    versions.commit(1, {"a": 3})
    assert versions.read() == (2, {"a": 3}) and versions.read(1) == (1, {"a": 1})
    assert versions.forget() == [{"a": 3}] and versions.numbers() == [2]


def test_buckets_that_hold_no_key_of_an_upsert_stay(spark, tmp_path):
    store = BucketTable(spark, str(tmp_path / "t"), "id long, v string", ["id"], buckets=8)
    assert store.read().count() == 0
    store.upsert(spark.range(100).select("id", F.lit("a").alias("v")))
    before = store.versions.read()[1]["held"]
    store.upsert(spark.createDataFrame([(7, "b"), (500, "new")], "id long, v string"))
    after = store.versions.read()[1]["held"]
    touched = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(touched) <= 2 and {r.id: r.v for r in store.read().where("v <> 'a'").collect()} == {7: "b", 500: "new"} and store.read().count() == 101
    store.delete(spark.createDataFrame([(7,), (12345,)], "id long"))
    assert store.read().count() == 100 and store.read(2).count() == 101
    store.delete(store.read().select("id"))
    assert store.read().count() == 0 and store.versions.read()[1]["held"] == {}
    assert store.vacuum() > 0
    assert store.upsert(spark.createDataFrame([], "id long, v string")) == store.versions.read()[0]


def test_rows_under_an_owner_give_way_in_one_version(spark, tmp_path):
    store = BucketTable(spark, str(tmp_path / "t"), schemas.TABLES["issues"], ["file_path"], buckets=4)
    rows = lambda *r: spark.createDataFrame(r, "id string, file_path string, title string")
    owners = lambda *r: spark.createDataFrame([(x,) for x in r], "file_path string")
    store.replace_under("file_path", owners("a", "b"), rows(("1", "a", "t"), ("2", "a", "t"), ("3", "b", "t"), ("4", "c", "stray")))
    store.replace_under("file_path", owners("a"), rows(("5", "a", "t")))
    assert ids(store.read()) == ["3", "5"]
    store.replace_under("file_path", owners("b"), rows())
    assert ids(store.read()) == ["5"]
    with pytest.raises(ValueError):
        store.replace_under("title", owners("a"), rows())


def test_migrations_go_on_from_the_stored_layout(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "w"))
    assert migrations.stored_version(store) == migrations.CURRENT and migrations.migrate(store) == []
    store = Warehouse(spark, str(tmp_path / "old"))
    store.write(spark.createDataFrame([(1, "a.py", "f")], "id long, file_path string, symbol_name string"), "code_index")
    store.write(spark.createDataFrame([("p", None), ("q", "draft")], "path string, status string"), "pages")
    notes = spark.createDataFrame([("file", "a", "old", "2026-01-01"), ("file", "a", "new", "2026-02-01"), ("general", "", "g", None)], "scope string, target string, content string, updated_at string")
    store.write(notes, "notes")
    store.write(spark.range(1), "x")
    store.spark.range(3).write.parquet(f"{store.base}/index/old")
    failing = [s if s.version != 6 else migrations.Step(6, "", "notes", lambda t: (_ for _ in ()).throw(RuntimeError("stopped"))) for s in migrations.STEPS]
    with pytest.raises(RuntimeError):
        migrations.migrate(store, failing)
    assert migrations.stored_version(store) == 5 and store.read("notes").count() == 3
    assert migrations.migrate(store) == [6] and migrations.migrate(store) == []
    assert store.read("code_index").first().raises == [] and {r.path: r.status for r in store.read("pages").collect()} == {"p": "complete", "q": "draft"}
    assert sorted(r.content for r in store.read("notes").collect()) == ["g", "new"] and not store.exists(f"{store.base}/index")
    with pytest.raises(RuntimeError):
        migrations.migrate(store, migrations.STEPS[:2])


def job(spark, k):
    return spark.createDataFrame([(k, "build", "running")], "id string, type string, status string")


def tree(spark, **files):
    return spark.createDataFrame([(f"src/{n}.py", len(t), t.encode()) for n, t in files.items()], "path string, length bigint, content binary")


def test_an_incremental_build_makes_and_indexes_changed_pages_only(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "base"))
    made = []

    def write(texts, parsed):
        made.append(sorted(r.file_path for r in texts.collect()))
        return pages.file_pages(texts, parsed)

    build.run(spark, store, tree(spark, a="def alpha():\n    beta()\n", b="def beta():\n    return 1\n", c="def gamma():\n    pass\n"), job(spark, "1"), page_of=write)
    assert made == [["src/a.py", "src/b.py", "src/c.py"]] and build.choose_mode(store) == "incremental"
    page = store.read("pages").where("target = 'src/a.py'").first()
    assert page.content.startswith("---\nsource: src/a.py\n") and "`alpha`" in page.content and page.status == "complete"
    index = build.page_index(store)
    assert len(ids(index.matches("alpha"))) == 1 and store.read("code_index").where("symbol_name = 'beta'").first().called_by == ["alpha"]
    segment = index.entries()["segments"][0]["name"]
    build.run(spark, store, tree(spark, a="def delta():\n    beta()\n", b="def beta():\n    return 1\n"), job(spark, "2"), page_of=write)
    assert made[1] == ["src/a.py"] and sorted(r.target for r in store.read("pages").collect()) == ["src/a.py", "src/b.py"]
    assert ids(index.matches("alpha")) == [] and ids(index.matches("gamma")) == [] and len(ids(index.matches("delta"))) == 1 and len(ids(index.matches("beta"))) == 1
    assert segment in {s["name"] for s in index.entries()["segments"]} and index.entries()["segments"][-1]["docs"] <= 2
    version = index.versions.read()[0]
    build.run(spark, store, tree(spark, a="def delta():\n    beta()\n", b="def beta():\n    return 1\n"), job(spark, "3"), page_of=write)
    assert made[2] == [] and index.versions.read()[0] == version


def test_a_build_reads_files_once(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "base"))
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    files = tree(spark, a="def alpha():\n    beta()\n", b="def beta():\n    return 1\n", c="x = 1\n" * 30)
    for k in (1, 2):
        build.run(spark, store, files.mapInArrow(counted, files.schema), job(spark, str(k)), page_of=pages.file_pages)
        assert read.value == 3 * k
    assert sorted(r.target for r in store.read("pages").collect()) == ["src/a.py", "src/b.py", "src/c.py"]


def test_an_index_left_behind_by_a_stop_is_made_up_for(spark, tmp_path, monkeypatch):
    store = Warehouse(spark, str(tmp_path / "base"))
    with monkeypatch.context() as m:
        m.setattr(build, "update_index", lambda *a: (_ for _ in ()).throw(RuntimeError("stopped")))
        with pytest.raises(RuntimeError):
            build.run(spark, store, tree(spark, a="def alpha():\n    pass\n"), job(spark, "1"), page_of=pages.file_pages)
    assert store.read("pages").count() == 1 and build.page_index(store).owners().count() == 0
    build.run(spark, store, tree(spark, a="def alpha():\n    pass\n"), job(spark, "2"), page_of=pages.file_pages)
    assert len(ids(build.page_index(store).matches("alpha"))) == 1


def test_pages_are_saved_by_path(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "base"))
    rows = lambda text: spark.createDataFrame([("p.md", "file", "a.py", text, "h")], "path string, type string, target string, content string, source_hash string")
    pages.save_pages(store, pages.page_rows(rows("# One"), plain=True))
    pages.save_pages(store, pages.page_rows(rows("# Two"), layer=F.lit("api")))
    (page,) = store.read("pages").collect()
    assert page.content.endswith("---\n\n# Two") and "layer: api\n" in page.content and page.metadata.startswith("{") and page.source_hash == "h"
    assert spark.createDataFrame([page]).select(fn.frontmatter_body(F.col("content"))).first()[0] == "# Two" and DEFAULT.chunk_tokens == 1000


def test_builds_write_chunks_vectors_and_progress(spark, tmp_path):
    store = Warehouse(spark, str(tmp_path / "base"))
    told = []
    embed = lambda chunks_: chunks_.select("chunk_id", F.array(F.length("content").cast("float"), F.lit(1.0).cast("float")).alias("embedding"))
    feed = build.record_progress(store, "1")

    def progress(*step):
        told.append(step)
        feed(*step)

    build.run(spark, store, tree(spark, a="def alpha():\n    pass\n", b="def beta():\n    pass\n"), job(spark, "1"), page_of=pages.file_pages, embed=embed, progress=progress)
    assert [p for p, *_ in told] == [*build.PHASES, "done"] and told[-1][1] == told[-1][2]
    chunk_rows, vectors = build.chunk_table(store).read(), build.vector_table(store).read()
    assert chunk_rows.count() == vectors.count() == build.page_index(store).totals().first().docs and vectors.where("size(embedding) = 2").count() == vectors.count()
    build.run(spark, store, tree(spark, a="def alpha():\n    pass\n"), job(spark, "2"), page_of=pages.file_pages, embed=embed)
    assert {r.path for r in build.vector_table(store).read().collect()} == {r.path for r in store.read("pages").collect()} == {"files/src-a-py.md"}
    out = jobs.read_progress(spark, store.base).writeStream.format("memory").queryName("told").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    out.awaitTermination()
    assert [r.phase for r in spark.table("told").orderBy("step").collect()] == [*build.PHASES, "done"]


def test_sqlite_tables_are_read_in_ranges(spark, tmp_path):
    path = str(tmp_path / "old store.db")
    with contextlib.closing(sqlite3.connect(path)) as db:
        db.execute('CREATE TABLE "notes x" (id INTEGER PRIMARY KEY, body TEXT, score REAL, data BLOB, "at" TIMESTAMP)')
        db.executemany('INSERT INTO "notes x" VALUES (?, ?, ?, ?, ?)', [(k * 3, f"n{k}" if k % 2 else None, k / 2 if k else 1, b"x" * k, "2026-01-01") for k in range(50)])
        db.execute('INSERT INTO "notes x" VALUES (1000, 5, \'no number\', NULL, NULL)')
        db.execute("CREATE TABLE none (a)")
        db.commit()
    rows = sqlite.read_table(spark, path, "notes x", rows_per_task=20)
    assert rows.rdd.getNumPartitions() > 5 and rows.count() == 51 and [f.dataType.simpleString() for f in rows.schema] == ["bigint", "string", "double", "binary", "string"]
    found = {r.id: r for r in rows.collect()}
    assert found[9].body == "n3" and found[9].score == 1.5 and bytes(found[9].data) == b"xxx" and found[0].score == 1.0 and found[1000].score is None and found[1000].body == "5"
    assert sqlite.table_names(path) == ["none", "notes x"] and sqlite.read_table(spark, path, "none").count() == 0
    with pytest.raises(ValueError):
        sqlite.read_table(spark, path, "gone")
