"""What is taken from a repository's files: paths, manifests, logo candidates and icons."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Manifests in the order they are taken, how many at most, and images of one paragraph that make badges.
MANIFESTS = ("go.mod", "package.json", "Cargo.toml", "pyproject.toml", "Chart.yaml")
MAX_MANIFESTS, BADGES = 6, 3
LOGO = r"(?i)(^|/)(logo|icon)[^/]*\.(svg|png|jpe?g|webp)$"


def blob_paths(tree: Column) -> Column:
    """Paths of the files of a tree (array of type and path)."""
    return F.transform(F.filter(tree, lambda x: (x["type"] == "blob") & (x["path"] != "")), lambda x: x["path"])


def shallowest(paths: Column) -> Column:
    """The path with the fewest parts, the alphabetically first of equals."""
    return F.array_min(F.transform(paths, lambda p: F.struct(F.size(F.split(p, "/")).alias("depth"), p.alias("path"))))["path"]


def manifest_selection(paths: Column) -> Column:
    """Known manifests at the root in declared order, and one nested chart if the root has none."""
    root = F.array_intersect(F.array(*[F.lit(m) for m in MANIFESTS]), paths)
    nested = shallowest(F.filter(paths, lambda p: p.endswith("/Chart.yaml")))
    chart = F.when(F.array_contains(root, "Chart.yaml") | nested.isNull(), F.array().cast("array<string>")).otherwise(F.array(nested))
    return F.slice(F.concat(root, chart), 1, MAX_MANIFESTS)


def logo_candidate(paths: Column, readme: Column, owner: Column) -> Column:
    """struct(source, url): a logo file, else the README's first image outside badge rows, else the owner's avatar."""
    file = shallowest(F.filter(paths, lambda p: F.regexp_like(p, F.lit(LOGO))))
    pattern = F.lit(r"(?:!\[[^\]]*\]\(|<img[^>]*src=[\x22'])([^)\x22'\s]+)")
    images = F.transform(F.split(F.coalesce(readme, F.lit("")), r"\n\s*\n"), lambda p: F.regexp_extract_all(p, pattern, F.lit(1)))
    plain = F.flatten(F.filter(images, lambda x: F.size(x) < BADGES))
    image = F.try_element_at(F.filter(plain, lambda u: ~F.regexp_like(u, F.lit(r"(?i)shields\.io|badge"))), F.lit(1))
    made = lambda s, u: F.when(u.isNotNull(), F.struct(F.lit(s).alias("source"), u.alias("url")))
    avatar = F.concat(F.lit("https://github.com/"), owner, F.lit(".png"))
    return F.coalesce(made("tree", file), made("readme", image), made("avatar", avatar))


def icon_descriptor(source: Column, url: Column, sizes: Column, fetched: Column) -> Column:
    """A descriptor if sizes were made and the url is https, else null."""
    from skarn.functions.text import is_https

    return F.when((F.size(sizes) > 0) & is_https(url), F.struct(source.alias("source"), url.alias("source_url"), fetched.alias("fetched_at")))


def kept_icon(previous: Column, error: Column, now: Column) -> Column:
    """What a failed fetch leaves: the icon that was good before with the error noted, else an empty one."""
    good = F.coalesce(previous["source"].isNotNull(), F.lit(False))
    field = lambda name: F.when(good, previous[name]).alias(name)
    sizes = F.when(good, previous["sizes"]).otherwise(F.array().cast("array<int>")).alias("sizes")
    return F.struct(field("source"), field("source_url"), sizes, now.alias("fetched_at"), error.alias("error"))
