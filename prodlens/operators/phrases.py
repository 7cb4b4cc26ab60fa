"""Phrase mining over a corpus (doc_id, text): TF-IDF n-grams, heuristic noun phrases, their union, ranking and statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed_values as fixed
from ..functions import text as T
from . import grams
from .layout import spread


def corpus(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", brands: list[str] = ()) -> DataFrame:
    """Cleaned documents, those without text left out."""
    rows = spread(df.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    # A filter on the cleaned text would move below spread(), clean there in few tasks, and clean again above it.
    some = F.filter(F.array(T.cleaned(F.col("text"), brands)), lambda t: t != "")
    return rows.select("doc_id", F.explode(some).alias("text"))


def _is_generic(phrase: Column) -> Column:
    return F.forall(F.split(phrase, " "), lambda w: w.isin(fixed.GENERIC_WORDS)) | (F.length(phrase) < 3)


def _terms(docs: DataFrame, stop_words: list[str], most: int = 3) -> DataFrame:
    words = F.filter(T.term_words(F.col("text")), lambda w: ~w.isin(stop_words))
    return docs.select("doc_id", T.ngrams(words, most).alias("terms"))


def _marks(terms: Column) -> Column:
    """(p, first): each occurrence of a term, and 1 at one occurrence of each, so that one row does for both frequencies."""
    return T.let(F.sort_array(terms), lambda t: F.transform(t, lambda p, i: F.struct(p.alias("p"), F.when((i > 0) & (F.get(t, i - 1) == p), 0).otherwise(1).alias("first"))))


def counted(terms: DataFrame) -> DataFrame:
    """(phrase, df, total) of all terms: document and corpus frequencies from one shuffle on the phrase, summed before it."""
    marks = terms.select(F.explode(_marks(F.col("terms"))).alias("m"))
    return marks.groupBy(F.col("m.p").alias("phrase")).agg(F.sum("m.first").alias("df"), F.count("*").alias("total"))


def _words(docs: DataFrame, stop_words: list[str]) -> DataFrame:
    """One column: the words that terms are made of, between spaces."""
    return grams.tokenised(docs.select(T.without_foreign_letters(F.lower("text"))), stop_words)


def _plain_words(docs: DataFrame) -> DataFrame:
    """One column: the lower-cased text with single spaces, squeezed only where that changes anything."""
    low = F.lower("text")
    return docs.select(F.when(low.rlike(r"(?U)[\s&&[^ ]]"), T.squeezed(low)).otherwise(low).alias("words"))


def _local(df: DataFrame) -> DataFrame:
    """A short list computed once, however many later steps read it."""
    return df.sparkSession.createDataFrame(df.collect(), df.schema)


def vocabulary(docs: DataFrame, min_df: int = 2, max_df: float = 0.85, cap: int = 5000, stop_words: list[str] = fixed.STOP_WORDS) -> tuple[DataFrame, int]:
    """(phrase, df, total) of the `cap` most frequent 1-3-grams with df from min_df to max_df of all documents, and the number of documents."""
    with grams.held(_words(docs, stop_words)) as words:
        return _vocabulary(words, docs, min_df, max_df, cap, stop_words)


def _vocabulary(words: DataFrame, docs: DataFrame, min_df: int, max_df: float, cap: int, stop_words: list[str]) -> tuple[DataFrame, int]:
    n = words.count()
    found = grams.most_frequent(words, cap, "total", min_df, lambda p, df: min_df <= df <= max_df * n)
    if found is None:
        kept = counted(_terms(docs, stop_words)).filter((F.col("df") >= min_df) & (F.col("df") <= max_df * n))
    else:
        kept = docs.sparkSession.createDataFrame([(" ".join(p), df, total) for p, df, total in found], "phrase string, df bigint, total bigint")
    return kept.orderBy(F.desc("total"), "phrase").limit(cap), n


def tfidf(docs: DataFrame, top_n: int | None = 200, min_df: int = 2, max_df: float = 0.85, cap: int = 5000, stop_words: list[str] = fixed.STOP_WORDS, occurrences: bool = True) -> DataFrame:
    """phrase, tfidf_score, doc_freq, total_occurrences, rank: 1-3-grams by document frequency, then summed length-normalised tf-idf.

    Smoothed idf, raw counts, rows of length 1. Occurrences count the phrase as a substring of the texts. Where no phrase qualifies
    (tiny corpora) the result is empty and `frequent_phrases` applies, as in `phrases_of`.
    """
    if occurrences and not docs.is_cached:
        with grams.held(docs) as texts:
            return tfidf(texts, top_n, min_df, max_df, cap, stop_words)
    spark = docs.sparkSession
    with grams.held(_words(docs, stop_words)) as words:
        kept, n = _vocabulary(words, docs, min_df, max_df, cap, stop_words)
        voc = kept.withColumn("idf", F.log(F.lit(1.0 + n) / (F.col("df") + 1)) + 1).collect()
        sums = {r["i"]: r["w"] for r in grams.summed_weights(words, [tuple(r["phrase"].split(" ")) for r in voc], [r["idf"] for r in voc]).collect()} if voc else {}
    scored = spark.createDataFrame([(r["phrase"], r["df"], sums[i]) for i, r in enumerate(voc) if i in sums], "phrase string, doc_freq bigint, w double").select("phrase", "doc_freq", F.round("w", 4).alias("tfidf_score"))
    best = scored.filter(~_is_generic(F.col("phrase"))).orderBy(F.desc("doc_freq"), F.desc("tfidf_score"), "phrase")
    best = _local(best if top_n is None else best.limit(top_n))
    best = best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("doc_freq"), F.desc("tfidf_score"), "phrase")))
    if not occurrences:
        return best.select("phrase", "tfidf_score", "doc_freq", "rank")
    return with_occurrences(best, docs).select("phrase", "tfidf_score", "doc_freq", "total_occurrences", "rank")


def phrases_of(docs: DataFrame, top_n: int = 200, min_df: int = 2) -> DataFrame:
    """phrase, tfidf_score, doc_freq, total_occurrences: by TF-IDF, and by frequency where no phrase qualifies for that, as in corpora of one or two texts."""
    columns = ["phrase", "tfidf_score", "doc_freq", "total_occurrences"]
    with grams.held(docs) as texts:
        out = tfidf(texts, top_n, min_df).select(*columns)
        return _local(frequent_phrases(texts, top_n, min_df)).select(*columns) if out.isEmpty() else out


def with_occurrences(phrases: DataFrame, docs: DataFrame) -> DataFrame:
    """phrases with total_occurrences: non-overlapping substring counts over all texts. The phrases (a top list) go to every document."""
    names = sorted({r["phrase"] for r in phrases.select("phrase").collect()})
    counts = grams.substring_counts(docs.select(F.lower("text").alias("text")), names).collect()
    total = docs.sparkSession.createDataFrame([(names[r["i"]], r["n"]) for r in counts], "phrase string, total_occurrences bigint")
    return phrases.join(F.broadcast(total), "phrase", "left").withColumn("total_occurrences", F.coalesce("total_occurrences", F.lit(0)))


def frequent_phrases(docs: DataFrame, top_n: int = 200, min_df: int = 2) -> DataFrame:
    """The fallback: 1-3-grams of plain words that are not all stop words, scored by count * (ln(N / (df + 1)) + 1)."""
    stop = sorted({*fixed.FALLBACK_STOP_WORDS, *fixed.GENERIC_WORDS})
    with grams.held(_plain_words(docs)) as words:
        n = words.count()
        found = grams.most_frequent(words, top_n, "df", min_df, lambda p, df: not set(p) <= set(stop))
    if found is None:
        plain = F.filter(F.split(T.squeezed(F.lower("text")), " "), lambda w: w != "")
        some = counted(docs.select("doc_id", F.filter(T.ngrams(plain), lambda g: ~F.forall(F.split(g, " "), lambda w: w.isin(stop))).alias("terms")))
    else:
        some = docs.sparkSession.createDataFrame([(" ".join(p), df, total) for p, df, total in found], "phrase string, df bigint, total bigint")
    score = F.round(F.col("total") * (F.log(F.lit(float(n)) / (F.col("df") + 1)) + 1), 4)
    return some.filter(F.col("df") >= min_df).select("phrase", score.alias("tfidf_score"), F.col("df").alias("doc_freq"), F.col("total").alias("total_occurrences")).orderBy(F.desc("doc_freq"), F.desc("tfidf_score"), "phrase").limit(top_n)


def noun_phrases(docs: DataFrame, top_n: int = 200, min_df: int = 2) -> DataFrame:
    """phrase, doc_freq, total_occurrences, root_word: words with a noun's ending, and pairs that start with an adjective or end so."""
    found = grams.noun_counts(_plain_words(docs), fixed.ADJECTIVES, fixed.NOUN_SUFFIXES)
    best = found.filter((F.col("doc_freq") >= min_df) & (F.length("phrase") >= 3)).orderBy(F.desc("doc_freq"), F.desc("total_occurrences"), "phrase").limit(top_n)
    return _local(best).withColumn("root_word", F.element_at(F.split("phrase", " "), -1))


def united(docs: DataFrame, top_n: int = 200, min_df: int = 2) -> DataFrame:
    """TF-IDF phrases and noun phrases of a corpus, the texts cleaned once for both."""
    with grams.held(docs) as texts:
        return union_of_sources(tfidf(texts, top_n, min_df), noun_phrases(texts, top_n, min_df))


def union_of_sources(terms: DataFrame, nouns: DataFrame) -> DataFrame:
    """Full outer join of both sources on the phrases' keys; the TF-IDF side's phrase wins, counts are maxima."""
    side = lambda df, own: df.withColumn("key", T.phrase_key(F.col("phrase"))).filter("key is not null").groupBy("key").agg(F.min_by("phrase", own).alias("phrase"), F.max("doc_freq").alias("df"), F.max("total_occurrences").alias("occ"), F.max("tfidf_score").alias("score"))
    a = side(terms, F.struct(-F.col("doc_freq"), -F.col("tfidf_score"), "phrase")).alias("a")
    b = side(nouns.withColumn("tfidf_score", F.lit(0.0)), F.struct(-F.col("doc_freq"), -F.col("total_occurrences"), "phrase")).alias("b")
    both = a.join(b, "key", "full_outer")
    source = F.when(F.col("a.phrase").isNull(), "spacy").when(F.col("b.phrase").isNull(), "tfidf").otherwise("both")
    most = lambda c: F.greatest(F.coalesce(f"a.{c}", F.lit(0)), F.coalesce(f"b.{c}", F.lit(0)))
    return both.select("key", F.coalesce("a.phrase", "b.phrase").alias("phrase"), most("df").alias("doc_freq"), most("occ").alias("total_occurrences"), F.coalesce("a.score", F.lit(0.0)).alias("tfidf_score"), source.alias("source"))


def merged_variants(phrases: DataFrame) -> DataFrame:
    """Phrases with one root become the one in most documents (on a tie the first by key); occurrences add up, scores are maxima."""
    order = F.struct(-F.col("doc_freq"), "key")
    out = phrases.groupBy(T.phrase_root(F.col("key")).alias("root")).agg(F.min_by(F.struct("key", "phrase", "doc_freq"), order).alias("best"), F.sum("total_occurrences").alias("total_occurrences"), F.max("tfidf_score").alias("tfidf_score"), F.min("source").alias("lo"), F.max("source").alias("hi"))
    return out.select("root", "best.key", "best.phrase", "best.doc_freq", "total_occurrences", "tfidf_score", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise("both").alias("source"))


def with_importance(phrases: DataFrame) -> DataFrame:
    """Importance 0 to 100 from shares of the maxima of document frequency, score and occurrences; more in both sources."""
    top = Window.partitionBy()  # over a merged top list, whose length the two top_n bound
    share = lambda c: F.col(c) / F.coalesce(F.nullif(F.max(c).over(top).cast("double"), F.lit(0.0)), F.lit(1.0))
    score = (0.4 * share("doc_freq") + 0.35 * share("tfidf_score") + 0.25 * share("total_occurrences")) * F.when(F.col("source") == "both", 1.15).otherwise(1.0) * 100
    return phrases.withColumn("importance_score", F.round(F.least(F.lit(100.0), score), 4))


def ranked(phrases: DataFrame, top_n: int | None = None) -> DataFrame:
    out = phrases.orderBy(F.desc("importance_score"), "key")
    return out if top_n is None else out.limit(top_n)


def analysed(df: DataFrame, top_n: int = 200, min_df: int = 2, id_col: str = "doc_id", text_col: str = "text", brands: list[str] = ()) -> DataFrame:
    """The whole phrase pipeline over raw texts."""
    with grams.held(corpus(df, id_col, text_col, brands)) as docs:
        both = union_of_sources(phrases_of(docs, top_n, min_df), noun_phrases(docs, top_n, min_df))
    return ranked(with_importance(merged_variants(both)), top_n)


def corpus_sizes(products: DataFrame, docs: DataFrame) -> DataFrame:
    """One row: products analysed, and documents left after cleaning."""
    return docs.agg(F.count("*").alias("corpus_size")).select(F.lit(products.count()).alias("products_analyzed"), "corpus_size")


def filtered(phrases: DataFrame, contains: str = "", band: str | None = None, source: str | None = None) -> DataFrame:
    """Phrases that hold a text (in any case), of an importance band (high from 70, medium from 40 to below 70) and of a source."""
    out = phrases.filter(F.contains(F.lower("phrase"), F.lit(contains.lower())))
    if band == "high":
        out = out.filter("importance_score >= 70")
    elif band == "medium":
        out = out.filter("importance_score >= 40 and importance_score < 70")
    return out if source is None else out.filter(F.col("source") == source)


def paged(phrases: DataFrame, by: str = "importance_score", descending: bool = True, page: int = 1, size: int = 50) -> DataFrame:
    """A page of phrases ordered by a column, strings in lower case, ties by phrase."""
    key = F.lower(by) if dict(phrases.dtypes)[by] == "string" else F.col(by)
    return phrases.orderBy(key.desc() if descending else key.asc(), "phrase").offset((page - 1) * size).limit(size)


def buckets(phrases: DataFrame, most: int = 100) -> DataFrame:
    """Importance bands with the first `most` phrases of each."""
    band = F.when(F.col("importance_score") >= 70, "high").when(F.col("importance_score") >= 40, "medium").otherwise("low")
    order = Window.partitionBy("bucket").orderBy(F.desc("importance_score"), "key")
    return phrases.withColumn("bucket", band).withColumn("pos", F.row_number().over(order)).filter(F.col("pos") <= most)


def source_counts(phrases: DataFrame) -> DataFrame:
    return phrases.agg(F.count("*").alias("total"), *(F.count_if(F.col("source") == s).alias(f"n_{s}") for s in ("tfidf", "spacy", "both")))


def kept_terms(phrases: DataFrame, names: DataFrame) -> DataFrame:
    """Phrases that a keep-list names, matched in lower case."""
    return phrases.join(names.select(F.lower("name").alias("kept_name")).distinct(), F.lower("phrase") == F.col("kept_name"), "left_semi")


def dropped_terms(phrases: DataFrame, names: DataFrame) -> DataFrame:
    return phrases.join(names.select(F.lower("name").alias("kept_name")).distinct(), F.lower("phrase") == F.col("kept_name"), "left_anti")


def selected_keywords(phrases: DataFrame, most: int = 6) -> DataFrame:
    """The (most + 10) // 2 first phrases by importance, then without repeats."""
    first = phrases.orderBy(F.desc("importance_score"), F.desc("tfidf_score"), "phrase").limit((most + 10) // 2)
    return first.groupBy(F.lower("phrase").alias("keyword")).agg(F.max("importance_score").alias("importance_score"))
