"""Classification by ordered rule tables: each rule is data with a test column; the first that holds wins."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skarn.functions.scoring import days_between
from skarn.vocabulary import Vocabulary, mapped

#: Confidence below which a verdict is ambiguous, and what stands in for missing verdicts.
AMBIGUOUS, FALLBACK_KIND, FALLBACK_DOMAIN, SUMMARY_CHARS = 0.7, "service", "dev-experience", 400
LEARNING = ("awesome", "tutorial", "course", "learning", "roadmap", "cheatsheet")
FOUNDATION_OWNERS = ("kubernetes", "kubernetes-sigs", "kubernetes-client", "cncf")


def _path(test) -> Column:
    return F.coalesce(F.exists("tree", test), F.lit(False))


def _topic(*names: str) -> Column:
    return F.coalesce(F.exists("topics", lambda t: t.isin(*names)), F.lit(False))


def _manifest(name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col("manifests"), F.lit(name)), F.lit(""))


def _like(text: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_like(text, F.lit(pattern)), F.lit(False))


def has_chart() -> Column:
    return _path(lambda p: (p == "Chart.yaml") | F.regexp_like(p, F.lit(r"(^|/)charts/[^/]+/Chart\.yaml$")))


def has_krew() -> Column:
    return _path(lambda p: (p == ".krew.yaml") | p.endswith("/.krew.yaml"))


def has_crd() -> Column:
    return _path(lambda p: p.startswith("config/crd/"))


def has_cmd() -> Column:
    return _path(lambda p: p.startswith("cmd/"))


def kind_rules() -> list[tuple[str, str, float, Column]]:
    """(rule, kind, confidence, test) in order; fixed values."""
    name, go = F.col("name"), _manifest("go.mod")
    return [
        ("tree:.krew.yaml", "kubectl-plugin", 0.95, has_krew()),
        ("name:kubectl-*", "kubectl-plugin", 0.80, _like(name, "^kubectl[-_]") | _topic("kubectl-plugin")),
        ("tree:config/crd+PROJECT (kubebuilder)", "operator", 0.95, has_crd() & _path(lambda p: p == "PROJECT")),
        ("topic:kubernetes-operator", "operator", 0.85, _topic("kubernetes-operator", "operator")),
        ("tree:Chart.yaml", "helm-chart", 0.90, has_chart()),
        ("manifest:controller-runtime", "controller", 0.80, go.contains("sigs.k8s.io/controller-runtime")),
        ("name:*-controller", "controller", 0.70, _like(name, "-controller$")),
        ("name:*-operator", "operator", 0.70, _like(name, "-operator$")),
        ("tree:webhook manifests", "admission-webhook", 0.75, _topic("admission-webhook") | _path(lambda p: F.regexp_like(p, F.lit(r"webhook.*\.yaml$")) & p.contains("admission"))),
        ("manifest:terraform-provider", "terraform-provider", 0.90, _like(name, "^terraform-provider-")),
        ("manifest:client-go without cmd", "library-sdk", 0.65, go.contains("k8s.io/client-go") & ~has_cmd()),
        ("manifest:@kubernetes/client-node", "library-sdk", 0.70, _manifest("package.json").contains("@kubernetes/client-node")),
        ("manifest:kube (Cargo.toml)", "library-sdk", 0.65, _like(_manifest("Cargo.toml"), r"(?m)^kube\s*=")),
        ("tree:cmd/ + cobra", "cli", 0.75, has_cmd() & go.contains("spf13/cobra")),
        ("topic:learning", "learning-resource", 0.80, _topic(*LEARNING) | _like(name, "^awesome-")),
    ]


def declared_kinds() -> list[str]:
    """The kinds that a rule can give, in the order of the rules."""
    return list(dict.fromkeys(kind for _, kind, _, _ in kind_rules()))


def with_kind(df: DataFrame) -> DataFrame:
    """Adds verdicts (all rules that hold, in order), kind, confidence and rule; null and 0 without a verdict."""
    hits = F.array(*[F.when(test, F.struct(F.lit(r).alias("rule"), F.lit(k).alias("kind"), F.lit(c).alias("confidence"))) for r, k, c, test in kind_rules()])
    df = df.withColumn("verdicts", F.array_compact(hits)).withColumn("_first", F.try_element_at("verdicts", F.lit(1)))
    return df.withColumns({"kind": F.col("_first.kind"), "rule": F.col("_first.rule"), "confidence": F.coalesce("_first.confidence", F.lit(0.0))}).drop("_first")


def domains(vocabulary: Vocabulary) -> Column:
    """Up to three domains that the topics stand for, in the topics' order."""
    found = F.transform(F.col("topics"), lambda t: mapped(vocabulary["domains"].aliases(), F.lower(t)))
    return F.coalesce(F.slice(F.array_distinct(F.array_compact(found)), 1, vocabulary["domains"].most), F.array())


def relevance() -> Column:
    parts = (
        (0.4, F.coalesce(F.exists("topics", lambda t: F.regexp_like(t, F.lit("^(kubernetes|k8s|kubectl|helm|openshift)"))), F.lit(False))),
        (0.2, _like(F.col("name"), "(?i)kube|k8s")),
        (0.15, _like(F.col("description"), "(?i)kubernetes|k8s")),
        (0.35, _manifest("go.mod").contains("k8s.io/") | has_chart() | has_crd()),
    )
    total = F.lit(0.0)
    for weight, test in parts:
        total = total + F.when(test, weight).otherwise(0.0)
    return F.least(F.lit(1.0), total)


def runtime() -> Column:
    """struct(runtime, confidence), from kind and the tree."""
    kind = lambda *k: F.coalesce(F.col("kind").isin(*k), F.lit(False))
    library = _manifest("go.mod").contains("k8s.io/client-go") | _manifest("package.json").contains("@kubernetes/client-node") | _like(_manifest("Cargo.toml"), r"(?m)^kube\s*=")
    chain = (
        (kind("distribution"), "cluster-itself", 0.9), (has_krew(), "workstation", 0.9), (kind("cli", "kubectl-plugin", "ide-extension"), "workstation", 0.65),
        (has_chart() | has_crd(), "in-cluster", 0.85), (_path(lambda p: p.isin("action.yml", "action.yaml")), "ci-pipeline", 0.8),
        (library & ~has_cmd(), "in-your-code", 0.7), (kind("operator", "controller", "admission-webhook", "helm-chart"), "in-cluster", 0.6),
    )
    made = lambda r, c: F.struct(F.lit(r).alias("runtime"), F.lit(c).alias("confidence"))
    out = made("unknown", 0.0)
    for test, r, c in reversed(chain):
        out = F.when(test, made(r, c)).otherwise(out)
    return out


def license_class(vocabulary: Vocabulary) -> Column:
    return F.coalesce(mapped(vocabulary["license_class"].aliases(), F.lower("license")), F.lit("unknown"))


def openness(class_: Column) -> Column:
    paid = _path(lambda p: F.regexp_like(p, F.lit("^(ee|enterprise)/"))) | _like(F.col("readme"), "(?i)enterprise edition|enterprise version|commercial license|commercial edition|business edition")
    return F.when(class_ == "source-available", "source-available").when(class_ == "unknown", "unknown").when(paid, "open-core").otherwise("fully-open")


def maturity(now: Column) -> Column:
    created, pushed, released = (days_between(now, F.col(c)) for c in ("created_at", "pushed_at", "released_at"))
    return (
        F.when(F.col("archived"), "archived")
        .when(F.col("cncf_level").isNotNull(), F.concat(F.lit("cncf-"), F.col("cncf_level")))
        .when(created.isNull() | pushed.isNull() | (created < 0), "unknown")
        .when(pushed > 365, "dormant")
        .when(created < 365, "young")
        .when((released <= 365) | (pushed <= 183), "established")
        .otherwise("unknown")
    )


def governance() -> Column:
    known = mapped({"foundation": "foundation", "vendor": "vendor-backed", "vendor-backed": "vendor-backed", "community": "community"}, F.col("org_type"))
    return F.when(F.lower("owner").isin(*FOUNDATION_OWNERS), "foundation").when(known.isNotNull(), known).when(F.col("owner_type") == "User", "individual").otherwise("unknown")


def package_identity() -> Column:
    """struct(ecosystem, name) of the first manifest that names a package."""
    go = F.regexp_extract(_manifest("go.mod"), r"(?m)^module\s+(\S+)", 1)
    npm = F.coalesce(F.get_json_object(_manifest("package.json"), "$.name"), F.lit(""))
    toml = lambda m: F.regexp_extract(_manifest(m), r"(?m)^name\s*=\s*\x22([^\x22]+)\x22", 1)
    made = lambda e, n: F.when(n != "", F.struct(F.lit(e).alias("ecosystem"), n.alias("name")))
    return F.coalesce(made("Go", go), made("npm", npm), made("crates.io", toml("Cargo.toml")), made("PyPI", toml("pyproject.toml")))


def analyze(df: DataFrame, vocabulary: Vocabulary, now: Column) -> DataFrame:
    """All passes as one projection: kind, domains, runtime, derived enums, relevance, review flag, summary."""
    df = with_kind(df).withColumn("domains", domains(vocabulary)).withColumn("k8s_relevance", F.round(relevance(), 6))
    df = df.withColumn("ambiguous", (F.col("confidence") < AMBIGUOUS) | (F.size("domains") == 0))
    df = df.withColumn("runtime", runtime()["runtime"]).withColumn("license_class", license_class(vocabulary))
    df = df.withColumns({"openness": openness(F.col("license_class")), "maturity": maturity(now), "governance": governance()})
    return df.withColumns(
        {
            "needs_review": F.col("ambiguous"), "method": F.lit("rules"), "summary": F.substring(F.coalesce("description", F.lit("")), 1, SUMMARY_CHARS),
            "kind": F.coalesce("kind", F.lit(FALLBACK_KIND)), "domains": F.when(F.size("domains") == 0, F.array(F.lit(FALLBACK_DOMAIN))).otherwise(F.col("domains")),
        }
    )
