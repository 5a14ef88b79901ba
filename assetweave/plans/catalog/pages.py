"""URLs, links and reachability over fetched pages."""

from pyspark.sql import functions as F

from assetweave.functions import urls
from assetweave.operators import web
from assetweave.plans.catalog.registry import query, role, table

SUFFIX = ","  # the supplied pages link to no .pdf; the suffix is a parameter

URLS = """SELECT page_id, CASE page_id % 8 WHEN 0 THEN url WHEN 1 THEN 'HTTP://WWW.Shop' || CAST(page_id AS VARCHAR(20)) || '.org:8080/a//b/'
  WHEN 2 THEN 'ftp://files.example.com/x.pdf' WHEN 3 THEN 'http://localhost:5000/' || CAST(page_id AS VARCHAR(20))
  WHEN 4 THEN 'not a url' WHEN 5 THEN url || '#frag' WHEN 6 THEN '//www.example.com/docs/..manual v' || CAST(page_id AS VARCHAR(20)) || '.PDF?x=1'
  ELSE 'https://' END AS url FROM pages """
_NET = r"regexp_extract(url, '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?//([^/?#]*)', 1)"


def _urls(spark, sf_dir):
    return role(spark, sf_dir, URLS, "pages")


@query(rf"""WITH u AS ({URLS}) SELECT page_id, replace(lower({_NET}), 'www.', '') AS domain, regexp_matches(url, '^(?i:https?):') AND {_NET} <> ''
 AND NOT contains({_NET}, 'localhost') AND NOT contains({_NET}, '127.0.0.1') AS valid,
 regexp_replace(lower({_NET}), ':.*$', '') = 'example.com' OR suffix(regexp_replace(lower({_NET}), ':.*$', ''), '.example.com') AS allowed,
 regexp_replace(regexp_replace(url, '#.*$', ''), '/+$', '') AS canonical, regexp_replace(url, '[#?].*$', '') AS document FROM u""")
def url_checks(spark, sf_dir):
    url = F.col("url")
    return _urls(spark, sf_dir).select(
        "page_id", urls.url_domain(url).alias("domain"), urls.valid_url(url).alias("valid"),
        urls.allowed_domain(url, F.lit("example.com")).alias("allowed"), urls.canonical_url(url).alias("canonical"),
        urls.canonical_url(url, document=True).alias("document"))


@query(r"""WITH u AS (""" + URLS + r"""), b AS (SELECT page_id, url, regexp_replace(replace(regexp_extract(regexp_replace(regexp_replace(url,
 '^(?:[a-zA-Z][a-zA-Z0-9+.\-]*:)?(?://[^/?#]*)?', ''), '[?#].*$', ''), '([^/]*)$', 1), '..', ''), '[/\\<>:"|?*]', '_', 'g') AS name FROM u),
 n AS (SELECT page_id, url, CASE WHEN suffix(lower(name), '.pdf') THEN name ELSE name || '.pdf' END AS name FROM b)
 SELECT page_id, CASE WHEN length(name) < 5 THEN 'document_' || left(sha256(url), 16) || '.pdf' ELSE name END AS file_name FROM n""")
def safe_file_names(spark, sf_dir):
    return _urls(spark, sf_dir).select("page_id", urls.safe_file_name(F.col("url")).alias("file_name"))


ROBOTS = r"""SELECT regexp_extract(url, '^(https?://[^/?#]*)', 1) || '/robots.txt' AS base, page_id, 'User-agent: *' || chr(10) || '  SITEMAP: /maps/' ||
  CAST(page_id AS VARCHAR(20)) || '.xml ' || chr(13) || chr(10) || '# sitemap: none' || chr(10) || 'Sitemap: https://cdn.example.org/s' ||
  CAST(page_id AS VARCHAR(20)) || '.xml' AS text FROM pages """


@query(r"""WITH r AS (""" + ROBOTS + r""") SELECT regexp_replace(base, 'robots.txt$', '') AS site, 1 AS pos,
 regexp_replace(base, '/robots.txt$', '/maps/' || page_id || '.xml') AS sitemap FROM r UNION ALL
 SELECT regexp_replace(base, 'robots.txt$', ''), 3, 'https://cdn.example.org/s' || page_id || '.xml' FROM r""")
def robots_sitemaps(spark, sf_dir):
    return web.sitemaps_from_robots(role(spark, sf_dir, ROBOTS, "pages")).select(
        F.regexp_replace("base", "robots.txt$", "").alias("site"), "pos", "sitemap")


MAPS = """SELECT url AS sitemap, page_id, '<urlset><url><loc> ' || replace(url, '&', '&amp;') || ' </loc></url>' || chr(10) || '<url><loc>https://x.example.com/' ||
  CAST(page_id AS VARCHAR(20)) || '.PDF</loc></url></urlset>' AS xml FROM pages """


@query("""SELECT url AS sitemap, 0 AS pos, url, CASE WHEN suffix(lower(url), '.pdf') THEN 'document' ELSE 'page' END AS kind FROM pages
 UNION ALL SELECT url, 1, 'https://x.example.com/' || page_id || '.PDF', 'document' FROM pages""")
def sitemap_locs(spark, sf_dir):
    return web.sitemap_locs(role(spark, sf_dir, MAPS, "pages"))


_VISIBLE = r"regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>', '', 'g')"
LINKS = rf"""raw AS (SELECT page_id, url AS src, unnest(regexp_extract_all({_VISIBLE}, '(?is)<a\s[^>]*href="([^"]*)"', 1)) AS href,
 generate_subscripts(regexp_extract_all({_VISIBLE}, '(?is)<a\s[^>]*href="([^"]*)"', 1), 1) - 1 AS pos FROM pages),
 links AS (SELECT page_id, src, CAST(pos AS INTEGER) AS pos, regexp_extract(src, '^(https?://[^/?#]*)', 1) || href AS dst FROM raw
 WHERE starts_with(href, '/')), kinds AS (SELECT *, CASE WHEN suffix(dst, '{SUFFIX}') THEN 'document' ELSE 'page' END AS kind FROM links)"""


def links(spark, sf_dir):
    return web.extract_links(table(spark, sf_dir, "pages"), SUFFIX)


@query(f"WITH {LINKS} SELECT page_id, src, pos, dst, kind FROM kinds")
def extract_links(spark, sf_dir):
    return links(spark, sf_dir)


@query(f"""WITH {LINKS}, r AS (SELECT *, row_number() OVER (PARTITION BY page_id ORDER BY pos) AS k FROM kinds WHERE kind = 'page')
 SELECT page_id, dst, kind FROM r WHERE k <= 3 UNION ALL SELECT page_id, dst, kind FROM kinds WHERE kind = 'document'""")
def cap_links(spark, sf_dir):
    return web.cap_links(links(spark, sf_dir), per_page=3).select("page_id", "dst", "kind")


# Fetched pages do not link to each other, so every page also gets an edge to the next one.
_EDGES = f"""{LINKS}, edges AS (SELECT DISTINCT src, pos, dst FROM (SELECT src, pos, dst FROM kinds WHERE kind = 'page' UNION ALL
 SELECT a.url, 2, b.url FROM pages a JOIN pages b ON b.page_id = a.page_id + 1)), seeds AS (SELECT DISTINCT
 regexp_extract(url, '^https?://([^/?#]*)', 1) AS site, url FROM pages)"""


def _level(n: int) -> str:
    return f""", s{n} AS (SELECT v.site, e.src, e.pos, e.dst AS url, row_number() OVER (PARTITION BY v.site, e.src ORDER BY e.pos, e.dst) AS k
 FROM v{n - 1} v JOIN edges e ON e.src = v.url WHERE v.depth = {n - 1} AND NOT EXISTS (SELECT 1 FROM v{n - 1} x WHERE x.site = v.site AND x.url = e.dst)),
 f{n} AS (SELECT site, url, {n} AS depth, src AS parent, pos, row_number() OVER (PARTITION BY site, url ORDER BY src, pos) AS nth FROM s{n} WHERE k <= 4),
 u{n} AS (SELECT site, url, depth, parent, pos FROM v{n - 1} UNION ALL SELECT site, url, depth, parent, pos FROM f{n} WHERE nth = 1),
 v{n} AS (SELECT * EXCLUDE (place) FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY depth, parent, pos, url) AS place FROM u{n}) WHERE place <= 50)"""


REACHED = f"""{_EDGES}, v0 AS (SELECT * EXCLUDE (place) FROM (SELECT site, url, 0 AS depth, '' AS parent, 0 AS pos,
 row_number() OVER (PARTITION BY site ORDER BY url) AS place FROM seeds) WHERE place <= 50){_level(1)}{_level(2)}"""


def reached(spark, sf_dir):
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    following = pages.select(F.col("url").alias("src"), (F.col("page_id") + 1).alias("page_id")).join(
        pages.withColumnRenamed("url", "dst"), "page_id").select("src", F.lit(2).alias("pos"), "dst", F.lit("page").alias("kind"))
    edges = links(spark, sf_dir).select("src", "pos", "dst", "kind").unionByName(following)
    seeds = pages.select(urls.authority(F.col("url")).alias("site"), "url")
    return web.reachable(edges, seeds, max_depth=2, per_page=4, per_site=50)


@query(f"WITH {REACHED} SELECT site, url, depth FROM v2")
def reachable_pages(spark, sf_dir):
    return reached(spark, sf_dir)


@query(f"""WITH {REACHED}, d AS (SELECT DISTINCT v.site, k.dst FROM v2 v JOIN kinds k ON k.src = v.url WHERE k.kind = 'document')
 SELECT v.site, count(DISTINCT v.url) AS pages, coalesce(max(n), 0) AS documents FROM v2 v LEFT JOIN (SELECT site, count(*) AS n FROM d GROUP BY site) USING (site) GROUP BY v.site""")
def site_summary(spark, sf_dir):
    visits = reached(spark, sf_dir)
    return web.site_summary(visits, web.site_documents(visits, links(spark, sf_dir)))
