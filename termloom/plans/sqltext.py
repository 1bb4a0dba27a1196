"""Common parts of the SQL that queries are held against."""

from __future__ import annotations

TOKEN = r"[\p{L}\p{N}]+"


def tok(table: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    return f"SELECT {key}, unnest(regexp_extract_all(lower({text}), '{TOKEN}')) AS term FROM {table}"


#: Postings, statistics and queries over documents and benchmark items.
BASE = f"""
tok AS ({tok()}),
p AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM tok GROUP BY ALL),
ts AS (SELECT term, count(*)::BIGINT AS df, sum(tf)::BIGINT AS ttf FROM p GROUP BY ALL),
dl AS (SELECT doc_id, sum(tf)::BIGINT AS dl FROM p GROUP BY ALL),
fs AS (SELECT count(*)::BIGINT AS n, sum(dl)::BIGINT AS total FROM dl),
q AS (SELECT item_id AS query_id, term, count(*)::DOUBLE AS boost
      FROM ({tok('benchmark', 'item_id')}) GROUP BY ALL)
"""

BM25 = "ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / (total / n)))"
DIRICHLET = "greatest(ln(1 + tf / ((ttf + 1) / (total + 1))) + ln(1 / (dl + 1.0)), 0)"
TFIDF = "log10(n / ttf) * df / dl"


def scored(similarity: str = BM25, q: str = "q") -> str:
    """The term scores of a query table."""
    return (
        f"SELECT {q}.*, p.doc_id, tf, boost * {similarity} AS score FROM {q} JOIN ts USING (term) "
        f"JOIN p USING (term) JOIN dl USING (doc_id) CROSS JOIN fs"
    )


def top(rows: str, k: int, digits: int = 4) -> str:
    """The k best of (query_id, doc_id, score), rounded."""
    return f"""
SELECT query_id, doc_id, score, rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id)::INT AS rank
  FROM (SELECT query_id, doc_id, round(score, {digits}) + 0.0 AS score FROM ({rows}))
) WHERE rank <= {k}
"""


#: Lines of documents as paragraphs.
LINES = "par AS (SELECT doc_id, (unnest(range(len(l))))::INT AS pos, unnest(l) AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))"

#: Site links of pages.
LINKS = (
    "links AS (SELECT page_id, replace(replace(replace(unnest(regexp_extract_all(html, 'href=\"/([^\"]+)\"', 1)), "
    "'enwiki:', ''), '%20', '_'), ' ', '_') AS name FROM pages)"
)

#: A tag from the sign after its name to its end; quoted values may hold the sign that ends it.
_REST = r"""(?:>|[\s/](?:[^>"'']|"[^"<]*"|''[^''<]*'')*>|[\s/][^>]*>)"""
_ANY = """(?:[^>"'']|"[^"<]*"|''[^''<]*'')*>|[^>]*>"""
_BLOCK = (
    "address|article|aside|blockquote|body|dd|details|div|dl|dt|fieldset|figcaption|figure|footer|form|h[1-6]|header|hr|html|li|"
    "main|menu|nav|ol|p|pre|section|table|tbody|td|tfoot|th|thead|tr|ul"
)
#: Paragraph elements of pages: from <p> to the next block's begin or end, without comments, scripts and inner tags.
PAGE_PARS = (
    "pc AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?s)<!--.*?-->', '', 'g'), "
    "'(?is)<script[\\s/>].*?</script\\s*>', '', 'g'), '(?is)<style[\\s/>].*?</style\\s*>', '', 'g') AS html FROM pages), "
    f"ps AS (SELECT page_id, string_split(regexp_replace(html, '(?i)</?(?:{_BLOCK})[\\s/>]', chr(2) || '\\0', 'g'), chr(2)) AS parts FROM pc), "
    "pl AS (SELECT page_id, list_filter(parts, lambda x: regexp_matches(x, '(?i)^<p[\\s/>]')) AS l FROM ps), "
    f"pp AS (SELECT page_id, pos, regexp_replace(regexp_replace(regexp_replace(x, '(?is)^<p{_REST}', ''), "
    f"'(?i)<br{_REST}', ' ', 'g'), '</?[a-zA-Z](?:{_ANY})', '', 'g') AS text "
    "FROM (SELECT page_id, (unnest(range(len(l))))::INT AS pos, unnest(l) AS x FROM pl))"
)
