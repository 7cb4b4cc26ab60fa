"""SQL (DuckDB dialect) fragments that restate the text functions independently of their Spark expressions."""

from __future__ import annotations

from ..functions import fixed_values as fixed


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


def lst(values: list[str]) -> str:
    return "[" + ", ".join(map(q, values)) + "]"


def rep(x: str, pattern: str, new: str) -> str:
    return f"regexp_replace({x}, {q(pattern)}, {q(new)}, 'g')"


def quoted(p: str) -> str:
    return "".join("\\" + c if c in ".^$*+?{}[]\\|()&" else c for c in p)


def squeezed(x: str) -> str:
    return f"trim({rep(x, r'[\s\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{3000}]+', ' ')})"


def cleaned(x: str) -> str:
    x = f"lower(coalesce({x}, ''))"
    x = rep(x, r"https?://\S+|www\.\S+", " ")
    x = rep(x, r"\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z|]{2,}\b", " ")
    x = rep(x, r"\b(?:" + "|".join(quoted(p) for p in fixed.MARKETING_PHRASES) + r")\b", " ")
    x = rep(x, r"&[a-z]+;|&#\d+;", " ")
    x = rep(x, "[–—]", "-")
    x = rep(x, r"[^\p{L}\p{M}\p{N}_\s.,\-°%]", " ")
    return f"array_to_string(list_filter(string_split({squeezed(x)}, ' '), lambda w: length(w) > 1 or list_contains({lst(fixed.UNITS)}, w)), ' ')"


def corpus(table: str = "documents", text: str = "text", key: str = "doc_id") -> str:
    return f"corpus as (select * from (select {key} as doc_id, {cleaned(text)} as text from {table}) where text <> '')"


def suffix(x: str) -> str:
    return "(" + " or ".join(f"{x} like '%{s}'" for s in fixed.NOUN_SUFFIXES) + ")"


def grams(words: str, most: int = 3) -> str:
    runs = [f"list_transform(range(1, greatest(len({words}) - {n - 1}, 0) + 1), lambda i: array_to_string({words}[i:i + {n - 1}], ' '))" for n in range(1, most + 1)]
    return f"list_concat({runs[0]}, list_concat({runs[1]}, {runs[2]}))"


def term_words(x: str) -> str:
    plain = rep(f"lower({x})", r"[^\x00-\x7F\P{L}]|[^\x00-\x7F\P{N}]", "_")
    return rf"regexp_extract_all({plain}, '\b([a-z][a-z0-9\-]*[a-z0-9]|[a-z])\b', 1)"


def tfidf(min_df: int = 2, max_df: float = 0.85, cap: int = 5000, top_n: int = 200) -> str:
    """CTEs up to `best` (phrase, doc_freq, tfidf_score)."""
    return f"""
    {corpus()},
    words as (select doc_id, list_filter({term_words("text")}, lambda w: not list_contains({lst(fixed.STOP_WORDS)}, w)) as w from corpus),
    g as (select doc_id, unnest({grams("w")}) as phrase from words),
    tf as (select doc_id, phrase, count(*) as n from g group by all),
    size as (select count(*) as n from corpus),
    voc as (select phrase, count(*) as df, sum(n) as total from tf group by phrase having count(*) >= {min_df} and count(*) <= {max_df} * (select n from size) order by total desc, phrase limit {cap}),
    wt as (select doc_id, phrase, df, tf.n * (ln((1.0 + (select n from size)) / (df + 1)) + 1) as w from tf join voc using (phrase)),
    nm as (select doc_id, sqrt(sum(w * w)) as norm from wt group by doc_id),
    sc as (select phrase, any_value(df) as doc_freq, round(sum(w / norm), 4) as tfidf_score from wt join nm using (doc_id) group by phrase),
    best as (select * from sc where length(phrase) >= 3 and len(list_filter(string_split(phrase, ' '), lambda x: not list_contains({lst(fixed.GENERIC_WORDS)}, x))) > 0 order by doc_freq desc, tfidf_score desc, phrase limit {top_n}),
    counted as (select best.phrase, doc_freq, tfidf_score, sum((length(text) - length(replace(text, best.phrase, ''))) // length(best.phrase))::bigint as total_occurrences from best, corpus group by all)"""


def nouns(min_df: int = 2, top_n: int = 200) -> str:
    """CTEs up to `noun` (phrase, doc_freq, total_occurrences), over `corpus`."""
    return f"""
    nw as (select doc_id, list_filter(string_split({squeezed("lower(text)")}, ' '), lambda w: w <> '') as w from corpus),
    pos as (select doc_id, w[i] as a, w[i + 1] as b from (select doc_id, w, unnest(range(1, len(w) + 1)) as i from nw)),
    found as (
      select doc_id, a as phrase, 1 as n from pos where length(a) >= 4 and {suffix("a")}
      union all
      select doc_id, a || ' ' || b, case when {suffix("a")} and {suffix("b")} then 2 else 1 end from pos where b is not null and (list_contains({lst(fixed.ADJECTIVES)}, a) or {suffix("b")})),
    noun as (select phrase, count(distinct doc_id) as doc_freq, sum(n)::bigint as total_occurrences from found where length(phrase) >= 3 group by phrase having count(distinct doc_id) >= {min_df} order by doc_freq desc, total_occurrences desc, phrase limit {top_n})"""


def key(x: str) -> str:
    k = rep(squeezed(f"lower({x})"), r"^[^\p{L}\p{M}\p{N}_]+|[^\p{L}\p{M}\p{N}_]+$", "")
    return f"case when length({k}) >= 2 then {k} end"


def root(x: str) -> str:
    one = "case when w like '%ies' then left(w, length(w) - 3) || 'y' when w like '%es' and length(w) > 4 then left(w, length(w) - 2) when w like '%s' and w not like '%ss' and length(w) > 3 then left(w, length(w) - 1) else w end"
    ing = "case when w like '%ing' and length(w) > 5 then left(w, length(w) - 3) else w end"
    ed = "case when w like '%ed' and length(w) > 4 then left(w, length(w) - 2) else w end"
    return f"array_to_string(list_transform(list_transform(list_transform(string_split({x}, ' '), lambda w: {one}), lambda w: {ing}), lambda w: {ed}), ' ')"


def merged() -> str:
    """CTEs up to `united` and `merged_variants`."""
    return f"""{tfidf()}, {nouns()},
    ka as (select * from (select {key("phrase")} as key, * from counted) where key is not null),
    kb as (select * from (select {key("phrase")} as key, * from noun) where key is not null),
    a as (select key, arg_min(phrase, (-doc_freq, -tfidf_score, phrase)) as phrase, max(doc_freq) as df, max(total_occurrences) as occ, max(tfidf_score) as score from ka group by key),
    b as (select key, arg_min(phrase, (-doc_freq, -total_occurrences, phrase)) as phrase, max(doc_freq) as df, max(total_occurrences) as occ from kb group by key),
    united as (select coalesce(a.key, b.key) as key, coalesce(a.phrase, b.phrase) as phrase, greatest(coalesce(a.df, 0), coalesce(b.df, 0)) as doc_freq, greatest(coalesce(a.occ, 0), coalesce(b.occ, 0)) as total_occurrences, coalesce(a.score, 0.0) as tfidf_score, case when a.key is null then 'spacy' when b.key is null then 'tfidf' else 'both' end as source from a full join b on a.key = b.key),
    v as (select {root("key")} as root, * from united),
    variants as (select root, arg_min(key, (-doc_freq, key)) as key, arg_min(phrase, (-doc_freq, key)) as phrase, max(doc_freq) as doc_freq, sum(total_occurrences)::bigint as total_occurrences, max(tfidf_score) as tfidf_score, case when count(distinct source) = 1 then min(source) else 'both' end as source from v group by root),
    mx as (select coalesce(nullif(max(doc_freq)::double, 0), 1) as d, coalesce(nullif(max(tfidf_score)::double, 0), 1) as s, coalesce(nullif(max(total_occurrences)::double, 0), 1) as o from variants),
    important as (select variants.*, round(least(100.0, (0.4 * doc_freq / mx.d + 0.35 * tfidf_score / mx.s + 0.25 * total_occurrences / mx.o) * case when source = 'both' then 1.15 else 1.0 end * 100), 4) as importance_score from variants, mx)"""
