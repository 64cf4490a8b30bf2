import json
import struct
import threading
from urllib.error import HTTPError
from urllib.parse import quote
from urllib.request import Request, urlopen

import pytest
from pyspark.sql import functions as F

from loam.__main__ import main
from loam.operators import index
from loam.plans import store
from loam.runtime import shared_dir
from loam.serve import FIELDS, Limit, make_server, searcher
from loam.sources.tables import Settings


@pytest.fixture(scope="module")
def root(spark):
    rows = [(1, "https://a.org", '<title>home</title><body>welcome cats <a href="/1">l</a></body>'), (2, "https://a.org/1", "<title>one & é</title><body>cats and dogs</body>"), (3, "https://b.org", "<title>x</title><body>unreached</body>")]
    root = shared_dir(spark)
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(f"{root}/snapshot")
    return root


def test_the_command_line(spark, root, monkeypatch, capsys):
    for k, v in {"LOAM_SEEDS": "https://a.org", "LOAM_SHOW_CRAWL_STATS": "true", "LOAM_SHOW_INDEX_STATS": "1"}.items():
        monkeypatch.setenv(k, v)
    main(["run", "cat", "--snapshot", f"{root}/snapshot", "--data", root], spark)
    said = capsys.readouterr().out
    assert "https://a.org/1" in said and "duplicates" in said and "total_token_count" in said
    for _ in range(2):
        main(["index", "--data", root], spark)
    assert store._versions(spark, root) == [2, 3]
    main(["rank", "--data", root, "zebra"], spark)
    assert "https" not in capsys.readouterr().out.split("zebra")[1]
    with pytest.raises(SystemExit):
        main(["crawl", "--data", root], spark)
    with pytest.raises(FileNotFoundError):
        store.latest_index(spark, root + "/none")


def test_http(spark, root):
    store.crawl_to(spark, spark.read.parquet(f"{root}/snapshot"), root, Settings(seeds=["https://a.org"]))
    store.index_to(spark, root, Settings())
    server = make_server(searcher(spark, root), Settings(port=0, requests_a_minute=8))
    threading.Thread(target=server.serve_forever, daemon=True).start()
    at = f"http://127.0.0.1:{server.server_address[1]}"

    def get(path, method="GET", **headers):
        with urlopen(Request(at + path, headers=headers, method=method)) as r:
            raw = r.read()
            return (json.loads(raw) if raw else None), r.headers

    try:
        assert get("/health")[0] == {"status": "ok"} and isinstance(get("/")[0], str)
        found, headers = get("/search/" + quote("dogs?"), Origin="http://localhost:3000")
        assert [list(r) for r in found] == [FIELDS] and found[0]["title"] == "one & é " and found[0]["url"] == "https://a.org/1"
        assert headers["Access-Control-Allow-Origin"] == "http://localhost:3000"
        assert "Access-Control-Allow-Origin" not in get("/search/zebra", Origin="https://else.org")[1]
        get("/search/x", "OPTIONS")
        with pytest.raises(HTTPError, match="404"):
            get("/nothing")
        for _ in range(3):
            get("/health")
        with pytest.raises(HTTPError, match="429"):
            get("/health")
    finally:
        server.shutdown()


def test_limit_slides():
    now = [0.0]
    limit = Limit(2, 60, lambda: now[0])
    assert [limit.admits("a"), limit.admits("a"), limit.admits("a"), limit.admits("b")] == [True, True, False, True]
    now[0] = 60.0
    assert limit.admits("a") and list(limit.times) == ["a"]


def test_byte_form_of_postings(spark):
    posts = spark.createDataFrame([("b", 2, 3, True, False), ("a", 9, 1, False, True), ("b", 1, 7, False, False)], "term string, page_id long, freq long, in_title boolean, in_domain boolean")
    got = index.postings_bytes(posts, index.term_dictionary(posts)).orderBy("byte_offset").collect()
    assert [(r.term, r.df, r.byte_offset, len(r.records)) for r in got] == [("a", 1, 0, 10), ("b", 2, 10, 20)]
    assert bytes(got[1].records) == struct.pack("<IIBBIIBB", 1, 7, 0, 0, 2, 3, 1, 0)
    with pytest.raises(Exception, match="32 bits"):
        index.postings_bytes(posts.withColumn("page_id", F.lit(1 << 32).cast("long")), index.term_dictionary(posts)).collect()
