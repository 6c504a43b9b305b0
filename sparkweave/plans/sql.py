"""Pieces of SQL that several oracles share."""

from ..functions.text import STOPWORDS, TOKEN

_QUOTED = ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS)


def tokens(text: str) -> str:
    return f"regexp_extract_all({text}, '{TOKEN}')"


def positions(table: str, key: str, text: str = "text") -> str:
    """(key, w, drop, pos) of every token."""
    return f"""SELECT {key}, lower(w) AS w, pos, regexp_full_match(w, '\\p{{P}}+') OR lower(w) IN ({_QUOTED}) AS drop
        FROM (SELECT {key}, unnest(l) AS w, generate_subscripts(l, 1) AS pos
              FROM (SELECT {key}, {tokens(f"coalesce({text}, '')")} AS l FROM {table}))"""


def postings(table: str, key: str, text: str = "text") -> str:
    """(key, term, tf) of the unigrams and bigrams that the filter keeps."""
    return f"""SELECT {key}, term, count(*) AS tf FROM (
        SELECT {key}, unnest(CASE WHEN drop THEN [] WHEN nd IS NULL OR nd THEN [w] ELSE [w, w || ' ' || nw] END) AS term
        FROM (SELECT *, lead(w) OVER s AS nw, lead(drop) OVER s AS nd FROM ({positions(table, key, text)})
              WINDOW s AS (PARTITION BY {key} ORDER BY pos)))
        GROUP BY ALL"""


def normalized(text: str) -> str:
    """The answer normal form. DuckDB's word boundary knows ASCII only, so whole words are compared instead."""
    plain = f"regexp_replace(lower({text}), '[!-/:-@\\[-`{{-~]', '', 'g')"
    pieces = f"regexp_extract_all({plain}, '[\\p{{L}}\\p{{N}}\\p{{M}}_]+|[^\\p{{L}}\\p{{N}}\\p{{M}}_]')"
    kept = f"array_to_string(list_transform({pieces}, lambda w: CASE WHEN w IN ('a', 'an', 'the') THEN ' ' ELSE w END), '')"
    return f"trim(regexp_replace({kept}, '\\s+', ' ', 'g'))"


#: Retrieval of documents for the benchmark's questions: (qid, doc_id, score) of all pairs with a shared term.
SCORES = f"""
    dp AS ({postings("documents", "doc_id")}),
    qp AS ({postings("(SELECT item_id AS qid, text FROM benchmark)", "qid")}),
    idf AS (SELECT term, greatest(ln(((SELECT count(*) FROM documents) - df + 0.5) / (df + 0.5)), 0) AS idf
            FROM (SELECT term, count(*) AS df FROM dp GROUP BY term)),
    scores AS (SELECT qid, doc_id, round(sum(ln(1 + qp.tf) * idf * ln(1 + dp.tf) * idf), 6) AS score
               FROM qp JOIN idf USING (term) JOIN dp USING (term) WHERE idf > 0 GROUP BY ALL),
    ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_id) AS rank FROM scores)"""
