"""The closed vocabulary as data: families of values with aliases, validated, as objects and as a table."""
from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Each family's id, url parameter, cardinality (with min and max), source, and its values with label
# and aliases. The value "unknown" is hidden.
FAMILIES = [
    ("kind", "kind", "one", None, "analyzer", [
        ("cli", "CLI"), ("kubectl-plugin", "kubectl plugin"), ("operator", "Operator"), ("controller", "Controller"),
        ("helm-chart", "Helm chart"), ("crd-library", "CRD library"), ("admission-webhook", "Admission webhook"),
        ("distribution", "Distribution"), ("dashboard-ui", "Dashboard / UI"), ("library-sdk", "Library / SDK"),
        ("terraform-provider", "Terraform provider"), ("ide-extension", "IDE extension"), ("service", "Service"),
        ("learning-resource", "Learning resource"),
    ]),
    ("domains", "domain", "many", (1, 3), "analyzer", [
        ("networking", "Networking", "networking", "cni", "ingress", "load-balancer"),
        ("security", "Security", "security", "rbac"),
        ("policy", "Policy", "policy", "opa"),
        ("storage", "Storage", "storage", "csi"),
        ("database", "Database", "database", "databases", "postgresql", "postgres", "mysql", "mariadb", "redis", "mongodb", "cassandra", "kafka", "etcd", "clickhouse"),
        ("observability", "Observability", "observability", "monitoring", "prometheus", "tracing", "logging"),
        ("ci-cd", "CI/CD", "ci-cd", "cicd"),
        ("gitops", "GitOps", "gitops", "argocd", "flux"),
        ("packaging", "Packaging", "helm", "packaging"),
        ("autoscaling", "Autoscaling", "autoscaling", "hpa"),
        ("scheduling", "Scheduling", "scheduling", "scheduler", "batch", "job-queue"),
        ("cost", "Cost", "finops", "cost"),
        ("multi-cluster", "Multi-cluster", "multi-cluster", "federation"),
        ("backup-dr", "Backup & DR", "backup", "disaster-recovery"),
        ("service-mesh", "Service mesh", "service-mesh", "istio", "envoy"),
        ("secrets", "Secrets", "secrets", "secrets-management", "vault", "sealed-secrets"),
        ("serverless", "Serverless", "serverless", "faas", "knative"),
        ("dev-experience", "Developer experience", "developer-tools"),
        ("testing", "Testing", "testing"),
        ("ai-ml", "AI / ML", "machine-learning", "mlops", "llm"),
        ("edge", "Edge", "edge", "iot"),
        ("troubleshooting", "Troubleshooting", "debugging", "troubleshooting"),
    ]),
    ("runtime", "runtime", "one", None, "analyzer", [
        ("in-cluster", "In cluster"), ("workstation", "Workstation"), ("ci-pipeline", "CI pipeline"), ("in-your-code", "In your code"),
        ("cluster-itself", "The cluster itself"), ("hosted-service", "Hosted service"), ("unknown", "Unknown"),
    ]),
    ("install_methods", "install", "many", None, "registry", [
        ("brew", "Homebrew"), ("mise", "mise"), ("asdf", "asdf"), ("krew", "krew"), ("helm", "Helm"), ("kubectl-apply", "kubectl apply"),
        ("go-install", "go install"), ("cargo", "cargo"), ("npm", "npm"), ("pip", "pip"), ("nix", "Nix"), ("arkade", "arkade"), ("apt", "apt"),
        ("container-image", "Container image"), ("curl-script", "curl script"), ("github-release", "GitHub release"), ("operator-hub", "OperatorHub"),
    ]),
    ("license_class", "license_class", "one", None, "derived", [
        ("permissive", "Permissive", "apache-2.0", "mit", "bsd-2-clause", "bsd-3-clause", "isc", "0bsd", "zlib", "bsl-1.0", "ncsa", "python-2.0", "artistic-2.0", "postgresql"),
        ("weak-copyleft", "Weak copyleft", "mpl-2.0", "lgpl-2.1", "lgpl-3.0", "epl-1.0", "epl-2.0", "cddl-1.0", "ms-pl"),
        ("copyleft", "Copyleft", "gpl-2.0", "gpl-3.0", "agpl-3.0", "osl-3.0", "eupl-1.2"),
        ("source-available", "Source available", "busl-1.1", "elastic-2.0", "sspl-1.0"),
        ("public-domain", "Public domain", "unlicense", "cc0-1.0", "wtfpl"), ("unknown", "Unknown"),
    ]),
    ("openness", "openness", "one", None, "derived", [("fully-open", "Fully open"), ("open-core", "Open core"), ("source-available", "Source available"), ("unknown", "Unknown")]),
    ("maturity", "maturity", "one", None, "derived", [
        ("cncf-graduated", "CNCF graduated"), ("cncf-incubating", "CNCF incubating"), ("cncf-sandbox", "CNCF sandbox"), ("established", "Established"),
        ("young", "Young"), ("dormant", "Dormant"), ("archived", "Archived"), ("unknown", "Unknown"),
    ]),
    ("governance", "governance", "one", None, "derived", [
        ("foundation", "Foundation"), ("vendor-backed", "Vendor backed"), ("community", "Community"), ("individual", "Individual"), ("unknown", "Unknown"),
    ]),
]


@dataclass(frozen=True)
class Value:
    id: str
    label: str
    aliases: tuple[str, ...] = ()
    hidden: bool = False


@dataclass(frozen=True)
class Family:
    id: str
    param: str
    cardinality: str
    source: str
    values: tuple[Value, ...]
    least: int | None = None
    most: int | None = None
    facet: bool = True

    def ids(self, hidden: bool = True) -> list[str]:
        return [v.id for v in self.values if hidden or not v.hidden]

    def aliases(self) -> dict[str, str]:
        return {a: v.id for v in self.values for a in v.aliases}


@dataclass(frozen=True)
class Vocabulary:
    families: tuple[Family, ...] = field(default_factory=tuple)

    def __getitem__(self, family: str) -> Family:
        return next(f for f in self.families if f.id == family)

    def frame(self, spark: SparkSession) -> DataFrame:
        """(family, value, label, hidden, alias): a row for each alias, one with a null alias where there is none."""
        rows = [(f.id, v.id, v.label, v.hidden, a) for f in self.families for v in f.values for a in (v.aliases or (None,))]
        return spark.createDataFrame(rows, "family string, value string, label string, hidden boolean, alias string")


def problems(families: list[Family]) -> list[str]:
    """What is wrong with a vocabulary."""
    found = []
    for what, names in (("family", [f.id for f in families]), ("param", [f.param for f in families])):
        found += [f"duplicate {what} {n}" for n in dict.fromkeys(names) if names.count(n) > 1]
    for f in families:
        ids, aliases = f.ids(), [a for v in f.values for a in v.aliases]
        if f.cardinality == "one" and (f.least is not None or f.most is not None):
            found.append(f"{f.id}: limits on a single value")
        if f.least is not None and f.most is not None and f.least > f.most:
            found.append(f"{f.id}: least over most")
        found += [f"{f.id}: duplicate value {i}" for i in dict.fromkeys(ids) if ids.count(i) > 1]
        found += [f"{f.id}: duplicate alias {a}" for a in dict.fromkeys(aliases) if aliases.count(a) > 1]
        found += [f"{f.id}: visible unknown" for v in f.values if v.id == "unknown" and not v.hidden]
        if f.source == "derived" and "unknown" not in ids:
            found.append(f"{f.id}: derived without unknown")
    return found


def checked(families: list[Family]) -> Vocabulary:
    if wrong := problems(families):
        raise ValueError("; ".join(wrong))
    return Vocabulary(tuple(families))


def standard() -> Vocabulary:
    families = []
    for name, param, cardinality, limits, source, entries in FAMILIES:
        values = tuple(Value(value, label, tuple(aliases), value == "unknown") for value, label, *aliases in entries)
        least, most = limits or (None, None)
        families.append(Family(name, param, cardinality, source, values, least, most))
    return checked(families)


def from_yaml(text: str) -> Vocabulary:
    """A vocabulary file: ``families`` with id, param, cardinality, min, max, source, facet and values."""
    import yaml

    families = []
    for f in yaml.safe_load(text)["families"]:
        values = tuple(Value(v["id"], v.get("label", v["id"]), tuple(v.get("aliases", ())), bool(v.get("hidden", False))) for v in f["values"])
        families.append(Family(f["id"], f.get("param", f["id"]), f["cardinality"], f["source"], values, f.get("min"), f.get("max"), bool(f.get("facet", False))))
    return checked(families)


def mapped(aliases: dict[str, str], key: Column) -> Column:
    """The value an alias stands for, null if none; the map is a literal of the vocabulary's fixed size."""
    pairs = [F.lit(x) for kv in aliases.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), key)


def is_valid(family: Family, values: Column) -> Column:
    """Whether an array holds only values of the family, as many as it allows."""
    size = F.size(F.array_distinct(values))
    known = F.forall(values, lambda v: v.isin(family.ids()))
    low, high = (1, 1) if family.cardinality == "one" else (family.least or 0, family.most or 10**6)
    return F.coalesce(known & size.between(low, high), F.lit(False))
