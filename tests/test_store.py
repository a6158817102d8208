import os

import pytest
from pyspark.sql import functions as F

from quarry.operators.catalog import Tools
from quarry.operators.enrich import HashingEmbedder
from quarry.operators.store import Store
from quarry.plans.ingest import Indexer
from quarry.schema import CATALOG, CHUNKS


def catalog(spark, *rows):
    made = [(p, p.split("/")[-1], h, 10, ".txt", "t", f"2024-01-0{i + 1}", s, ["k1", "k2"], 1, 10, 3, [1.0, 0.0]) for i, (p, h, s) in enumerate(rows)]
    return spark.createDataFrame(made, CATALOG)


def chunks(spark, *rows):
    return spark.createDataFrame([(p, h, i, t, 0, 3, 3, 1, "", "", "", "", "", "", [0.0, 1.0]) for p, h, i, t in rows], CHUNKS)


def test_lifecycle(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s.catalog().collect() == [] and s.version == 0
    assert s.upsert(catalog(spark, ("/a", "h1", "A"), ("/it's", "h2", "B")), chunks(spark, ("/a", "h1", 0, "x"), ("/a", "h1", 1, "y"), ("/it's", "h2", 0, "z"))) == 2
    assert s.exists("/it's", "h2") and not s.exists("/a", "h2")
    assert s.upsert(catalog(spark, ("/a", "h1", "again")), chunks(spark)) == 0 and s.version == 1
    assert s.upsert(catalog(spark, ("/a", "h1", "forced")), chunks(spark, ("/a", "h1", 0, "n")), force=True) == 1
    assert {r["file_path"]: r["summary"] for r in s.catalog().collect()} == {"/a": "forced", "/it's": "B"}
    assert sorted(r["chunk_text"] for r in s.chunks().collect()) == ["n", "z"]
    assert s.upsert(catalog(spark, ("/a", "h9", "new")), chunks(spark, ("/a", "h9", 0, "q"))) == 1
    assert s.delete(["/it's", "/none"]) == 1 and s.delete(["/it's"]) == 0
    assert [r["chunk_text"] for r in s.chunks().collect()] == ["q"]
    again = Store(spark, f"file://{tmp_path}/store")
    s.compact()
    assert s.vacuum() == 0 and s.vacuum(older_than=0) > 0
    assert [(r["file_path"], r["file_hash"]) for r in again.catalog().collect()] == [("/a", "h9")]
    assert s.upsert(catalog(spark, ("/it's", "h2", "back")), chunks(spark, ("/it's", "h2", 0, "z"))) == 1
    assert again.catalog().count() == 2


def test_an_uncommitted_change_does_not_count(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.upsert(catalog(spark, ("/a", "h1", "A")), chunks(spark))
    catalog(spark, ("/b", "h1", "B")).write.parquet(f"file://{tmp_path}/store/data/lost/catalog")
    assert s.catalog().count() == 1


def test_older_tables_get_the_missing_columns(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    s.upsert(catalog(spark, ("/a", "h1", "A")), chunks(spark, ("/a", "h1", 0, "x")).drop("element_type", "extracted_by"))
    s.upsert(catalog(spark, ("/b", "h1", "B")), chunks(spark, ("/b", "h1", 0, "y")))
    assert {r["element_type"] for r in s.chunks().collect()} == {""}


def one(spark, path, h="h", summary="s"):
    return catalog(spark, (path, h, summary)), chunks(spark, (path, h, 0, f"text of {path}"))


def paths(s):
    return sorted((r["file_path"], r["summary"]) for r in s.catalog().collect())


class Between(Store):
    """A store that lets another writer act right before its commit."""

    act = None

    def _commit(self, *args, **kw):
        if self.act is not None:
            act, self.act = self.act, None
            act()
        return super()._commit(*args, **kw)


def test_two_writers_of_one_path(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    mine, other = Between(spark, root), Store(spark, root)
    mine.act = lambda: other.upsert(*one(spark, "/a", "h2", "other"))
    assert mine.upsert(*one(spark, "/a", "h1", "mine")) == 1
    # The later commit holds, and the path is there once.
    assert paths(mine) == paths(other) == [("/a", "mine")] and mine.version == 2 and mine.chunks().count() == 1


def test_a_number_is_given_once(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store")
    assert s._publish(1, {"folder": "x", "tables": []}) and not s._publish(1, {"folder": "y", "tables": []})
    assert s._commit_of(1).folder == "x" and s._numbers() == [1]


def test_many_writers_at_once(spark, tmp_path):
    from concurrent.futures import ThreadPoolExecutor

    root = f"file://{tmp_path}/store"
    with ThreadPoolExecutor(6) as pool:
        assert list(pool.map(lambda i: Store(spark, root).upsert(*one(spark, f"/{i % 4}", f"h{i}", f"{i}")), range(8))) == [1] * 8
    s = Store(spark, root)
    assert len(s.commits()) == 8 and sorted(r["file_path"] for r in s.catalog().collect()) == ["/0", "/1", "/2", "/3"] and s.chunks().count() == 4


def test_changes_during_a_compaction_stay(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    mine, other = Between(spark, root), Store(spark, root)
    other.upsert(*one(spark, "/a"))
    other.upsert(*one(spark, "/x"))

    def act():
        other.upsert(*one(spark, "/b"))
        other.delete(["/x"])

    mine.act = act
    mine.compact()
    assert paths(mine) == [("/a", "s"), ("/b", "s")] and sorted(r["file_path"] for r in mine.chunks().collect()) == ["/a", "/b"]
    mine.compact()
    assert paths(other) == [("/a", "s"), ("/b", "s")] and len(other.commits()) == 1
    assert mine.vacuum(older_than=0) == 5 and paths(other) == [("/a", "s"), ("/b", "s")]


def test_vacuum_leaves_what_is_being_written(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    mine, other = Between(spark, root), Store(spark, root)
    other.upsert(*one(spark, "/a"))
    mine.act = lambda: other.vacuum()
    assert mine.upsert(*one(spark, "/b")) == 1 and len(paths(other)) == 2
    # One that is gone all the same is an error and no silent loss.
    mine.act = lambda: other.vacuum(older_than=0)
    with pytest.raises(RuntimeError):
        mine.upsert(*one(spark, "/c"))
    assert len(paths(other)) == 2


def test_a_missing_folder_is_an_error(spark, tmp_path):
    import shutil

    s = Store(spark, f"file://{tmp_path}/store")
    s.upsert(*one(spark, "/a"))
    shutil.rmtree(f"{tmp_path}/store/data/{s.commits()[0].folder}")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        s.catalog().collect()


def test_many_changes_are_one_scan_and_compact_themselves(spark, tmp_path):
    s = Store(spark, f"file://{tmp_path}/store", compact_after=4)
    for i in range(4):
        s.upsert(*one(spark, f"/{i}"))
    plan = s._table(s.commits(), "catalog", "file_path string")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and len(s.commits()) == 4
    s.upsert(*one(spark, "/4"))
    assert len(s.commits()) == 1 and len(paths(s)) == 5
    s.delete(["/2"])
    assert len(paths(s)) == 4 and s.exists("/3", "h")


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("watched")
    (folder / "sub").mkdir()
    (folder / "contract.txt").write_text("The agreement covers payment terms. Payment is due in thirty days. " * 20)
    (folder / "sub" / "garden.md").write_bytes("Tomatoes grow well.\r\nWater the tomatoes daily. Häuser".encode("latin-1"))
    (folder / "empty.txt").write_text("")
    (folder / ".hidden.txt").write_text("secret")
    (folder / "skip.bin").write_text("bin")
    (folder / "bad.docx").write_text("no zip")
    store = Store(spark, f"file://{tmp_path_factory.mktemp('s')}/store")
    return folder, Indexer(spark, store), store


def test_ingest_and_tools(spark, indexed):
    folder, ix, store = indexed
    uri = f"file://{folder}"
    assert ix.index(uri) == {"indexed": 3, "deleted": 0, "failed": 1}
    assert ix.index(uri)["indexed"] == 0
    tools = Tools(store, HashingEmbedder(), ix.reindex)
    found = tools.search_documents({"query": "tomatoes water garden", "limit": "1"})
    assert found["success"] and found["results"][0]["file_name"] == "garden.md" and found["total_results"] == 1
    hits = tools.search_documents('{"query": "payment due thirty days", "limit": 5, "search_type": "chunks"}')
    assert hits["total_results"] == sum(map(len, hits["results"].values())) == 2 and next(iter(hits["results"])).endswith("contract.txt")
    pages = [tools.get_catalog({"skip": i, "limit": 2}) for i in (0, 2, 9)]
    assert [p["returned"] for p in pages] == [2, 1, 0] and pages[0]["total_documents"] == 3
    assert pages[0]["stats"]["file_types"] == {".txt": 2, ".md": 1}
    path = found["results"][0]["file_path"]
    info = tools.get_document_info({"file_path": path})
    assert info["document"]["total_chunks"] == info["document"]["actual_chunks"] == 1 and len(info["document"]["file_hash"]) == 64
    assert tools.get_document_info({"file_path": "/none"}) == {"success": False, "error": "Document not found: /none"}
    assert tools.reindex_document({"file_path": path})["error"] == "Document unchanged"
    assert tools.reindex_document({"file_path": path}, force=True)["success"]
    stats = tools.get_indexing_stats()["stats"]
    assert stats["total_documents"] == 3 and "chunk_types" not in stats
    row = store.catalog().where(F.col("file_name") == "empty.txt").first()
    assert row["summary"] == "Empty document" and row["total_chunks"] == row["total_chars"] == 0
    assert "Häuser" in store.chunks().where(F.col("file_path") == path).first()["chunk_text"]
    for bad in ({"query": ""}, {"query": "x", "limit": 0}, {"query": "x", "search_type": "y"}, "{", 5, {}):
        assert not tools.search_documents(bad)["success"]


def test_changes_and_deletions(indexed):
    folder, ix, store = indexed
    uri = f"file://{folder}"
    ix.index(uri)
    before = {r["file_name"]: r["file_hash"] for r in store.catalog().collect()}
    (folder / "contract.txt").write_text("Wholly different now.")
    (folder / "empty.txt").unlink()
    assert ix.index(uri) == {"indexed": 1, "deleted": 0, "failed": 1}
    after = {r["file_name"]: r["file_hash"] for r in store.catalog().collect()}
    assert after["contract.txt"] != before["contract.txt"] and "empty.txt" in after
    assert ix.index(uri, deletions=True)["deleted"] == 1


def test_empty_statistics(spark, tmp_path):
    tools = Tools(Store(spark, f"file://{tmp_path}/none"))
    s = tools.get_indexing_stats()["stats"]
    assert s["total_documents"] == s["total_chunks"] == s["total_chars"] == 0 and s["file_types"] == {}
    assert tools.search_documents({"query": "x"})["results"] == []


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
@pytest.mark.parametrize("name", ["store_upsert", "store_delete"])
def test_no_key_is_sent_to_the_driver(spark, name):
    from quarry.plans.queries import QUERIES

    spark.conf.set("spark.sql.maxBroadcastTableSize", "1b")  # what is broadcast goes through the driver, and fails
    try:
        assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 100
    finally:
        spark.conf.unset("spark.sql.maxBroadcastTableSize")
