import json
import threading
import urllib.error
import urllib.request

import pytest

from quillsearch import __main__ as cli
from quillsearch.plans.catalogues import docs_catalogue
from quillsearch.plans.index import build_index
from quillsearch.service import Service, served


@pytest.fixture(scope="module")
def service(spark):
    return Service(build_index(docs_catalogue(spark, "/root/testdata/sf0.001")))


def test_search_and_suggest(service, capsys):
    title = service.index.docs.orderBy("doc").first().title
    got = service.search(title, limit="3", boost="no number", both=True)
    assert 1 <= len(got["new"]["results"]) <= 3 and not got["new"]["fallback"] and got["new"]["strategy"]
    assert {"title", "category", "year", "why", "number"} <= set(got["new"]["results"][0])
    assert len(got["old"]["results"]) <= 3 and got["old"]["total"] >= len(got["old"]["results"])
    assert service.search("", limit="0")["new"] == service.search("", limit="-5")["new"]
    none = service.search("'; drop -- qqqqzzzz", limit="2")["new"]
    assert len(none["results"]) == 2
    phrase = service.phrases.orderBy("phrase").first()
    if phrase:
        assert all(p != phrase.phrase[:3] for p in service.suggest(phrase.phrase[:3])["suggestions"])
        assert service.suggest(phrase.phrase[:3])["suggestions"]
    assert service.suggest("x")["suggestions"] == []
    assert "results via" in cli.told(got)


def test_http(service):
    server = served(service, port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}"
    try:
        with urllib.request.urlopen(f"{base}/api/search?q=the&limit=2") as r:
            assert r.headers["Content-Type"] == "application/json" and len(json.load(r)["new"]["results"]) <= 2
        with urllib.request.urlopen(f"{base}/api/suggest?q=") as r:
            assert json.load(r)["suggestions"] == []
        with urllib.request.urlopen(base) as r:
            assert b"<form" in r.read()
        with pytest.raises(urllib.error.HTTPError) as wrong:
            urllib.request.urlopen(f"{base}/etc/passwd")
        assert wrong.value.code == 404
    finally:
        server.shutdown()
        server.server_close()


def test_no_catalogue(tmp_path):
    with pytest.raises(SystemExit):
        cli.main(["search", "x", "--catalogue", str(tmp_path / "none.csv")])
