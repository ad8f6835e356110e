"""op3: every page judged by rules and by a list of URLs."""
from pyspark.sql import functions as F

from queryscope.llm import urls
from queryscope.llm.registry import query
from queryscope.workloads.registry import table

# --- fixed values: the rules, and site names whose pages make the list of blocked URLs --
RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]
LISTED_SITES = ["spam-farm", "cheap-pills", "free-bets"]
_SITE = rf"(^|\.)({'|'.join(LISTED_SITES)})\."

_PARTS = r"""
parts AS (SELECT page_id, coalesce(url, '') AS u,
  translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
  regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path,
  list_sort(list_filter(string_split(regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*[^?#]*\?([^#]*)', 1), '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(utm_[^=&]*|ref|gclid|fbclid)(=|$)'))) AS params
  FROM pages),
canon AS (SELECT page_id, host, path, CASE WHEN host <> '' THEN regexp_replace(regexp_replace(host, '^www\.', ''), ':(80|443)$', '') || regexp_replace(path, '/$', '')
  || CASE WHEN len(params) > 0 THEN '?' || array_to_string(params, '&') ELSE '' END END AS c FROM parts),
listed AS (SELECT DISTINCT c FROM canon WHERE regexp_matches(host, '(^|\.)(spam-farm|cheap-pills|free-bets)\.')),
ruled AS (SELECT *, CASE
  WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
  WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
  WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule FROM canon)
"""


@query("op3_url_filter", "WITH" + _PARTS + """
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow'
  WHEN c IN (SELECT c FROM listed WHERE c IS NOT NULL) THEN 'block' ELSE 'allow' END AS verdict,
  rule IS NULL AND c IS NOT NULL AND c IN (SELECT c FROM listed WHERE c IS NOT NULL) AS listed FROM ruled""")
def op3_url_filter(spark, sf_dir):
    """The tables hold no list of URLs, so the pages of a few listed sites make it; other spellings of these URLs are caught as well."""
    pages = table(spark, sf_dir, "pages")
    listed = pages.select("url").filter(urls.host_of(F.col("url")).rlike(_SITE))
    return urls.judge(pages, listed, RULES)
