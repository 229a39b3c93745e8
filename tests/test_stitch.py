"""Stitching of calls to endpoints: templates, cut paths, known ends, verbs, hosts."""

import pytest

from factloom.operators import stitch

ENDPOINTS = [
    ("version", "shop", "exchange", "/version", "GET"), ("orders", "shop", "exchange", "/v1/orders", "ANY"), ("order", "shop", "/exchange/", "/v1/orders/{Id}", "GET"), ("order-post", "shop", "exchange", "/v1/orders/{Id}", "POST"),
    ("part", "shop", "exchange", "/v1/{Id}/GetFilePart", "GET"), ("all", "shop", "files", "/*", "GET"), ("deep", "store", "a/b", "/c", "GET"), ("rootless", "store", "", "/x", "GET"), ("other", "store", "exchange", "/version", "GET"),
]
PROJECTS = [("erp.local", "shop"), ("store.local", "store"), ("closed.local", "closed")]
CASES = [
    (("GET", "erp.local", "/erp/hs/exchange/version", "static", ""), ("stitched", "host-mapped", "version", 0.9)),
    (("GET", "", "/any/hs/EXCHANGE/Version", "static", ""), ("stitched", "path-only", "other,version", 0.6)),
    (("GET", "erp.local", "/erp/hs/exchange/v1/orders/17?x=1#y", "static", ""), ("stitched", "host-mapped", "order", 0.9)),
    (("DELETE", "erp.local", "/erp/hs/exchange/v1/orders/17", "static", ""), ("stitched", "verb-not-allowed", "order,order-post", 0.9)),
    (("", "erp.local", "/erp/hs/exchange/v1/orders/17", "static", ""), ("stitched", "host-mapped", "order,order-post", 0.9)),
    (("GET", "erp.local", "/hs/exchange/v1/orders/", "prefix", ""), ("stitched", "host-mapped", "order,orders,part", 0.7)),
    (("GET", "erp.local", "/hs/exchange/v1/ord", "prefix", ""), ("stitched", "host-mapped", "order,orders,part", 0.7)),
    (("GET", "erp.local", "/hs/exchange/v1/", "prefix", "/GetFilePart"), ("stitched", "host-mapped", "order,part", 0.7)),
    (("GET", "erp.local", "/hs/exchange/v1/", "prefix", "FilePart?q"), ("stitched", "host-mapped", "order,part", 0.7)),
    (("GET", "erp.local", "/hs/exchange/v1/x", "prefix", "/GetFilePart"), ("stitched", "host-mapped", "part", 0.7)),
    (("GET", "erp.local", "/hs/exch", "prefix", ""), ("unknown", "prefix-before-root", "", 0.0)),
    (("GET", "erp.local", "/download/", "prefix", ""), ("unknown", "prefix-without-hs", "", 0.0)),
    (("GET", "erp.local", "/hs/exchange/nothing", "static", ""), ("external", "no-endpoint", "", 0.0)),
    (("GET", "erp.local", "/odata/x", "static", ""), ("external", "no-endpoint", "", 0.0)),
    (("GET", "erp.local", "/hs/files/a/b/c", "static", ""), ("stitched", "host-mapped", "all", 0.9)),
    (("GET", "erp.local", "/hs/files", "static", ""), ("stitched", "host-mapped", "all", 0.9)),
    (("GET", "store.local", "/hs/a/b/c", "static", ""), ("stitched", "host-mapped", "deep", 0.9)),
    (("GET", "closed.local", "/hs/exchange/version", "static", ""), ("unknown", "project-not-loaded", "", 0.0)),
    (("GET", "elsewhere", "/hs/exchange/version", "static", ""), ("external", "host-unmapped", "", 0.0)),
    (("GET", "erp.local", "", "dynamic", ""), ("dynamic", "dynamic-path", "", 0.0)),
    (("GET", "erp.local", "/hs/exchange/v1/%6Frders", "static", ""), ("stitched", "host-mapped", "orders", 0.9)),
]


@pytest.fixture(scope="module")
def found(spark):
    calls = spark.createDataFrame([(i, *c, "") for i, (c, _) in enumerate(CASES)], "id int, verb string, host string, path string, path_kind string, suffix string, reason string")
    endpoints = spark.createDataFrame(ENDPOINTS, "endpoint string, project string, root string, template string, verb string")
    return {x.id: (x.kind, x.reason, x.endpoints, x.confidence) for x in stitch.stitched(calls, endpoints, spark.createDataFrame(PROJECTS, "host string, project string")).collect()}


@pytest.mark.parametrize("k", range(len(CASES)))
def test_stitch(found, k):
    assert found[k] == CASES[k][1], CASES[k][0]


def test_endpoints_of_one_template_are_one_class(spark):
    endpoints = spark.createDataFrame([(f"e{i}", "shop", "x", "/{id}" if i % 3 else f"/{i}", ("GET", "get", "POST")[i % 3 - 1]) for i in range(300)], "endpoint string, project string, root string, template string, verb string")
    _, below = stitch.trie(endpoints)
    assert below.where("node = 'x/{}'").count() == 1
    calls = spark.createDataFrame([(0, "GET", "", "/hs/x/9", "static", "", ""), (1, "GET", "", "/hs/x/", "prefix", "", ""), (2, "PUT", "", "/hs/x/1", "prefix", "", "")], "id int, verb string, host string, path string, path_kind string, suffix string, reason string")
    got = {x.id: x.endpoints.split(",") for x in stitch.stitched(calls, endpoints, spark.createDataFrame(PROJECTS, "host string, project string")).collect()}
    same = [f"e{i}" for i in range(300) if i % 3]
    assert got[0] == sorted(same)
    assert got[1] == sorted(same)
    assert got[2] == sorted([*same, *(f"e{i}" for i in range(300) if i % 3 == 0 and str(i).startswith("1"))])
