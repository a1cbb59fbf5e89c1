import datetime as dt

import pytest
from pyspark.sql import functions as F

from skarn import vocabulary
from skarn.operators import classify
from skarn.vocabulary import Family, Value

V = vocabulary.standard()
NOW = dt.datetime(2026, 8, 1)
SCHEMA = """repo string, name string, description string, topics array<string>, tree array<string>, manifests map<string,string>, owner string, owner_type string, license string,
readme string, archived boolean, created_at timestamp, pushed_at timestamp, released_at timestamp, cncf_level string, org_type string"""


def ago(days):
    return NOW - dt.timedelta(days=days)


#: Shapes of six typical repositories and what they are.
CASES = [
    (("k/kubectx", "kubectx", "Switch kubernetes contexts", ["kubectl", "kubernetes"], [".krew.yaml", "cmd/main.go"], {"go.mod": "require spf13/cobra"}, "someone", "User", "Apache-2.0", "", False, ago(3000), ago(20), ago(100), None, None),
     ("kubectl-plugin", "tree:.krew.yaml", [classify.FALLBACK_DOMAIN], "workstation", "permissive", "fully-open", "established", "individual")),
    (("c/cert", "cert", "certificates", ["security"], ["config/crd/x.yaml", "PROJECT"], {"go.mod": "sigs.k8s.io/controller-runtime"}, "c", "Organization", "Apache-2.0", "", False, ago(3000), ago(2), ago(20), "graduated", "foundation"),
     ("operator", "tree:config/crd+PROJECT (kubebuilder)", ["security"], "in-cluster", "permissive", "fully-open", "cncf-graduated", "foundation")),
    (("p/charts", "charts", None, ["helm", "prometheus"], ["charts/a/Chart.yaml"], {}, "p", "Organization", "MIT", "", False, ago(2000), ago(5), None, None, None),
     ("helm-chart", "tree:Chart.yaml", ["packaging", "observability"], "in-cluster", "permissive", "fully-open", "established", "unknown")),
    (("d/sheet", "cheatsheet-k8s", None, ["cheatsheet", "tutorial"], ["README.md"], {}, "d", "User", None, "", False, ago(3000), ago(1900), None, None, None),
     ("learning-resource", "topic:learning", [classify.FALLBACK_DOMAIN], "unknown", "unknown", "unknown", "dormant", "individual")),
    (("s/core", "core", None, ["postgres"], ["config/crd/x.yaml", "PROJECT", "enterprise/a.go"], {}, "s", "Organization", "AGPL-3.0", "", False, ago(900), ago(9), ago(9), None, "vendor-backed"),
     ("operator", "tree:config/crd+PROJECT (kubebuilder)", ["database"], "in-cluster", "copyleft", "open-core", "established", "vendor-backed")),
    (("s/tf", "terraform-provider-x", None, [], [], {}, "s", "Organization", "BUSL-1.1", "", False, ago(900), ago(9), ago(9), None, None),
     ("terraform-provider", "manifest:terraform-provider", [classify.FALLBACK_DOMAIN], "unknown", "source-available", "source-available", "established", "unknown")),
    (("n/none", "dotfiles", None, None, None, None, "n", "User", "own", None, True, None, None, None, None, None),
     ("service", None, [classify.FALLBACK_DOMAIN], "unknown", "unknown", "unknown", "archived", "individual")),
]


def test_repositories_are_classified(spark):
    df = spark.createDataFrame([c for c, _ in CASES], SCHEMA)
    got = {r.repo: r for r in classify.analyze(df, V, F.lit(NOW)).collect()}
    for case, want in CASES:
        r = got[case[0]]
        assert (r.kind, r.rule, r.domains, r.runtime, r.license_class, r.openness, r.maturity, r.governance) == want
    assert got["n/none"].k8s_relevance == 0 and got["k/kubectx"].k8s_relevance == pytest.approx(0.75) and got["n/none"].needs_review
    assert got["k/kubectx"].verdicts[0].confidence == 0.95 and len(got["k/kubectx"].verdicts) >= 2


def test_declared_order_beats_confidence(spark):
    row = ("a/b", "kubectl-x", None, [], ["config/crd/x", "PROJECT"], {}, "a", "User", None, None, False, ago(1), ago(1), None, None, None)
    r = classify.with_kind(spark.createDataFrame([row], SCHEMA)).first()
    assert (r.kind, r.confidence) == ("kubectl-plugin", 0.8)


@pytest.mark.parametrize(("created", "pushed", "released", "want"), [(400, 366, None, "dormant"), (364, 1, None, "young"), (800, 184, 365, "established"), (800, 183, None, "established"), (800, 184, 366, "unknown"), (800, 184, None, "unknown"), (-1, 1, None, "unknown")])
def test_maturity_bands(spark, created, pushed, released, want):
    row = ("a/b", "x", None, [], [], {}, "a", "User", None, None, False, ago(created), ago(pushed), ago(released) if released else None, None, None)
    assert spark.createDataFrame([row], SCHEMA).select(classify.maturity(F.lit(NOW)).alias("m")).first().m == want


@pytest.mark.parametrize(("manifests", "want"), [({"go.mod": "module x.y/z\n", "package.json": '{"name":"n"}'}, ("Go", "x.y/z")), ({"package.json": "broken", "Cargo.toml": '[package]\nname = "c"'}, ("crates.io", "c")), ({"pyproject.toml": 'name = "p"'}, ("PyPI", "p")), ({}, None)])
def test_package_identity(spark, manifests, want):
    p = spark.createDataFrame([(manifests,)], "manifests map<string,string>").select(classify.package_identity().alias("p")).first().p
    assert (tuple(p) if p else None) == want


def test_vocabulary_sizes_and_pinning(spark):
    assert len(V.families) == 8 and sum(len(f.values) for f in V.families) == 83 and sum(len(f.aliases()) for f in V.families) == sum(len(v.aliases) for f in V.families for v in f.values)
    assert {k for _, k, *_ in classify.kind_rules()} <= set(V["kind"].ids()) and V.frame(spark).where("hidden").count() == 5


def family(**change):
    return Family(**({"id": "a", "param": "a", "cardinality": "many", "source": "analyzer", "values": (Value("x", "X", ("p",)),)} | change))


@pytest.mark.parametrize(
    "wrong",
    [
        [family(), family(param="b")], [family(), family(id="b")], [family(cardinality="one", least=1)], [family(least=3, most=2)], [family(values=(Value("x", "X"), Value("x", "Y")))],
        [family(values=(Value("unknown", "U"),))], [family(values=(Value("x", "X", ("p",)), Value("y", "Y", ("p",))))], [family(source="derived")],
    ],
)
def test_invalid_vocabularies_are_refused(wrong):
    with pytest.raises(ValueError):
        vocabulary.checked(wrong)


def test_yaml_vocabulary():
    pytest.importorskip("yaml")
    v = vocabulary.from_yaml("families:\n  - {id: k, param: k, cardinality: one, source: analyzer, facet: true, values: [{id: a, label: A, aliases: [b]}]}\n")
    assert v["k"].aliases() == {"b": "a"}
