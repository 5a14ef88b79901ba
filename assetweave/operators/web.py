"""Jobs over already fetched pages: sitemaps, links and bounded reachability."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from assetweave.functions import text, urls
from assetweave.functions.arrays import explode_computed
from assetweave.session import cut_lineage


def sitemaps_from_robots(robots: DataFrame) -> DataFrame:
    """(base, pos, sitemap) of the sitemap lines in robots(base, text)."""
    lines = explode_computed(robots, F.split("text", r"\r\n|\r|\n"), "line", "base", position="pos") \
        .withColumn("line", text.strip(F.col("line"))) \
        .filter(F.lower("line").startswith("sitemap:"))
    target = text.strip(F.regexp_replace("line", r"^[^:]*:", ""))
    return lines.select("base", "pos", urls.resolve_url(F.col("base"), target).alias("sitemap"))


def sitemap_locs(sitemaps: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(sitemap, pos, url, kind) of the <loc> values in sitemaps(sitemap, xml)."""
    locs = F.regexp_extract_all("xml", F.lit(r"(?s)<loc\b[^>]*>(.*?)</loc>"), F.lit(1))
    return (explode_computed(sitemaps, locs, "raw", "sitemap", position="pos")
            .select("sitemap", "pos", _decode(text.strip(F.col("raw"))).alias("url"))
            .withColumn("kind", F.when(urls.is_document(F.col("url"), suffix), "document").otherwise("page")))


def _decode(c):
    """The five predefined character references."""
    for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return c


_HREF = r"""(?is)<a(?:\s[^>]*?)?\shref\s*=\s*("[^"]*"|'[^']*'|[^\s>"']+)"""
_INVISIBLE = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"


def extract_links(pages: DataFrame, suffix: str = ".pdf") -> DataFrame:
    """(page_id, src, pos, dst, kind) of the same-host links of pages(page_id, url, html).

    Everything happens inside the row; a link list is never longer than its page.
    """
    found = F.regexp_extract_all(F.regexp_replace("html", _INVISIBLE, ""), F.lit(_HREF), F.lit(1))
    links = explode_computed(pages, found, "raw", "page_id", F.col("url").alias("src"), position="pos") \
        .withColumn("href", text.strip(_decode(F.regexp_replace("raw", r"""^["']|["']$""", "")))) \
        .filter((F.col("href") != "") & ~F.col("href").rlike(r"^(?:#|mailto:|tel:)")) \
        .withColumn("dst", urls.resolve_url(F.col("src"), F.col("href"))) \
        .filter(urls.authority(F.col("dst")) == urls.authority(F.col("src")))
    return links.select("page_id", "src", "pos", "dst", F.when(
        urls.is_document(F.col("dst"), suffix), "document").otherwise("page").alias("kind"))


def cap_links(links: DataFrame, per_page: int) -> DataFrame:
    """First `per_page` page links of every page; document links are never limited.

    The row limit is pushed below the shuffle for the page links.
    """
    window = Window.partitionBy("page_id").orderBy("pos")
    pages = links.filter(F.col("kind") == "page").withColumn("place", F.row_number().over(window)) \
        .filter(F.col("place") <= per_page).drop("place")
    return pages.unionByName(links.filter(F.col("kind") != "page"))


def reachable(links: DataFrame, seeds: DataFrame, max_depth: int = 2, per_page: int | None = None,
              per_site: int | None = None) -> DataFrame:
    """(site, url, depth) reached from seeds(site, url) along links(src, pos, dst, kind).

    Breadth first: a URL belongs to its smallest depth. A page follows its first `per_page`
    unseen links, and a site keeps its first `per_site` URLs by (depth, parent, position);
    without these limits everything within `max_depth` is reached. One join per level; each level is materialised so that the plan
    does not grow with the depth.
    """
    page_links = links.filter(F.col("kind") == "page").select("src", "pos", "dst").distinct()
    level = seeds.filter(urls.valid_url(F.col("url"))).select("site", "url").distinct() \
        .withColumn("depth", F.lit(0)).withColumn("parent", F.lit("")).withColumn("pos", F.lit(0))
    visited = cut_lineage(_cap_site(level, per_site))
    frontier = visited
    for depth in range(1, max_depth + 1):
        steps = (frontier.select("site", F.col("url").alias("src")).join(page_links, "src")
                 .select("site", "src", "pos", F.col("dst").alias("url"))
                 .filter(urls.valid_url(F.col("url")))
                 .join(visited.select("site", "url"), ["site", "url"], "left_anti"))
        if per_page is not None:
            window = Window.partitionBy("site", "src").orderBy("pos", "url")
            steps = steps.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= per_page)
        fresh = (steps.groupBy("site", "url").agg(F.min(F.struct("src", "pos")).alias("via"))
                 .select("site", "url", F.lit(depth).alias("depth"), F.col("via.src").alias("parent"),
                         F.col("via.pos").alias("pos")))
        candidates = visited.unionByName(fresh)
        visited = cut_lineage(_cap_site(candidates, per_site))
        frontier = visited.filter(F.col("depth") == depth)
    return visited.select("site", "url", "depth")


def _cap_site(df: DataFrame, per_site: int | None) -> DataFrame:
    if per_site is None:
        return df
    window = Window.partitionBy("site").orderBy("depth", "parent", "pos", "url")
    return df.withColumn("place", F.row_number().over(window)).filter(F.col("place") <= per_site).drop("place")


def site_summary(visits: DataFrame, documents: DataFrame) -> DataFrame:
    """Pages visited and distinct documents found per site: visits(site, url), documents(site, url)."""
    tagged = visits.select("site", "url", F.lit(0).alias("doc")).unionByName(
        documents.select("site", "url", F.lit(1).alias("doc"))).distinct()
    return tagged.groupBy("site").agg(F.count_if(F.col("doc") == 0).alias("pages"),
                                      F.count_if(F.col("doc") == 1).alias("documents"))


def site_documents(visits: DataFrame, links: DataFrame) -> DataFrame:
    """(site, url) of the documents linked from visited pages."""
    found = links.filter(F.col("kind") == "document").select(F.col("src").alias("url"), "dst").distinct()
    return visits.select("site", "url").join(found, "url").select("site", F.col("dst").alias("url")).distinct()
