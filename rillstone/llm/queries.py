"""The pN_ queries on training data, and their oracles for DuckDB where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.catalog import REVIEWS, STOP, TERMS
from rillstone.llm import abuse, cooccurrence, distinctive, leakage, mixing, similar_sets, term_frequency, terms, top_terms
from rillstone.plans.cut import cut
from rillstone.sources import reviews as src

Query = Callable[[SparkSession, str], DataFrame]
EDGES = ("business_id", "user_id")


def _stop(s: SparkSession, d: str) -> list[str]:
    return src.stopwords(src.table(s, d, "stopword"))


def _keyed(s: SparkSession, d: str) -> DataFrame:
    raw = src.table(s, d, "train_review")
    return raw.select(*[src.blank_to_null(c).alias(c) for c in ("review_id", *EDGES)], "text")


def _audiences(s: SparkSession, d: str) -> DataFrame:
    """Users (`member`) of each business (`key`). Copies of a review name the same pair, so they need no extra care."""
    raw = src.table(s, d, "train_review")
    named = raw.where(src.blank_to_null("review_id").isNotNull()).select(*[src.blank_to_null(c).alias(c) for c in EDGES])
    return named.select(F.col("business_id").alias("key"), F.col("user_id").alias("member"))


def p1_terms(s: SparkSession, d: str) -> DataFrame:
    """Every term of all reviews with its occurrences, its reviews and its mark."""
    return term_frequency.term_frequencies(src.distinct_reviews(src.table(s, d, "train_review"), "text"))


def p1_found(s: SparkSession, d: str) -> DataFrame:
    return p1_terms(s, d).where("mark IS NOT NULL").select("term", "mark")


def p2_found(s: SparkSession, d: str) -> DataFrame:
    """The five content terms of most reviews of every business and every user."""
    of = lambda kind, c: F.struct(F.lit(kind).alias("kind"), F.col(c).alias("gid"))
    groups = F.array(of("business", "business_id"), of("user", "user_id"))
    rows = _keyed(s, d).select(groups.alias("groups"), F.col("review_id").alias("record"), "text")
    counts = terms.grouped_counts(rows, _stop(s, d), "records")
    best = top_terms.top_n(counts, ["kind", "gid"], "n", "term", 5)
    return best.select(F.col("kind").alias("group_kind"), F.col("gid").alias("group_id"), "term")


def p3_pairs(s: SparkSession, d: str) -> DataFrame:
    """Similar audiences as pairs between classes of equal audiences, each named by its smallest business."""
    pairs, members = similar_sets.similar_sets(_audiences(s, d))
    names = members.groupBy("id").agg(F.min("key").alias("name"), F.count(F.lit(1)).alias("businesses"))
    one, two = (names.select(F.col("id").alias(i), F.col("name").alias(f"class{k}"), F.col("businesses").alias(f"businesses{k}")) for i, k in (("a", 1), ("b", 2)))
    both = pairs.join(one, "a").join(two, "b")
    swap = F.col("class1") > F.col("class2")
    pick = lambda c, x, y: F.when(swap, F.col(f"{c}{y}")).otherwise(F.col(f"{c}{x}")).alias(f"{c}{x}")
    return both.select(*[pick(c, *at) for c in ("class", "businesses") for at in ((1, 2), (2, 1))], F.round("sim", 6).alias("sim"))


def p3_found(s: SparkSession, d: str) -> DataFrame:
    pairs, members = similar_sets.similar_sets(_audiences(s, d))
    return similar_sets.expanded(pairs, members).select(F.col("k1").alias("b1"), F.col("k2").alias("b2"))


def _distinctive(s: SparkSession, d: str, least: int) -> DataFrame:
    rows = _keyed(s, d).select(F.lit("business").alias("kind"), F.col("business_id").alias("gid"), F.col("review_id").alias("record"), "text")
    counts = terms.grouped_counts(rows, _stop(s, d), "occurrences")
    return distinctive.distinctive_terms(counts, least=least)


def p4_scores(s: SparkSession, d: str) -> DataFrame:
    """A z-score for every content term of every business; outstanding are those of 3 or more."""
    scored = _distinctive(s, d, 1)
    return scored.select(F.col("gid").alias("business_id"), "term", "k", F.round("z", 4).alias("z"), (F.round("z", 4) >= 3).alias("outstanding"))


def p4_found(s: SparkSession, d: str) -> DataFrame:
    """Terms of the distinctive-term operator with three occurrences or more whose tf-idf reaches the limit.

    The contract defines these rows by tf-idf, from the operator's k, n and d. This isn't the log-odds result: that is
    `p4_scores`, and z decides nothing here.
    """
    scored = _distinctive(s, d, 3)
    n_all = src.table(s, d, "train_review").select(src.blank_to_null("business_id").alias("b")).where("b IS NOT NULL").distinct().count()
    tfidf = F.col("k") / F.col("n") * F.log2(F.lit(float(max(n_all, 1))) / F.col("d"))
    return scored.where(tfidf >= F.lit(0.0517)).select(F.col("gid").alias("business_id"), "term")


def p5_surprise(s: SparkSession, d: str) -> DataFrame:
    """Every pair of businesses with a common user, with lift, expectation under the null, p and q."""
    edges = cooccurrence.edges_of(_audiences(s, d))
    pairs, items, n = cooccurrence.pair_counts(edges, 1, distinct=True)
    found = cooccurrence.surprise(pairs, items, cooccurrence.basket_sizes(edges), n, 1)
    return found.select(F.col("k1").alias("b1"), F.col("k2").alias("b2"), "c", "n1", "n2", *[F.round(c, 6).alias(c) for c in ("lift", "expected", "log10_p", "q")], "surprising")


def p5_found(s: SparkSession, d: str) -> DataFrame:
    """Pairs with five common users or more and a lift of three or more, from the operator's exact counts.

    The contract defines these rows by counts alone, so the null isn't fitted here: its tails are in `p5_surprise`.
    """
    pairs, _, n = cooccurrence.pair_counts(_audiences(s, d), most_share=1 / 3)
    return pairs.where(F.col("c") * n >= 3 * F.col("n1") * F.col("n2")).select(F.col("k1").alias("b1"), F.col("k2").alias("b2"))


def p7_tiles(s: SparkSession, d: str) -> DataFrame:
    """Documents and the items they share at least five consecutive words with, with the share of the item that is covered.

    A pair leaks if a tile has twelve words, or if tiles in any order cover half of the item.
    """
    found = leakage.leaks(src.table(s, d, "documents"), src.table(s, d, "eval_item"), least_words=5)
    leaking = (F.col("longest") >= 12) | (F.col("coverage") >= 0.5)
    return found.select("doc_id", "item_id", "tiles", "longest", "covered", F.round("coverage", 6).alias("coverage"), leaking.alias("leaks"))


def p7_found(s: SparkSession, d: str) -> DataFrame:
    """Documents with twelve consecutive words of an item."""
    return leakage.leaks(src.table(s, d, "documents"), src.table(s, d, "eval_item"), least_words=12).select("doc_id", "item_id")


def p7_items(s: SparkSession, d: str) -> DataFrame:
    """Per item that leaked: the documents that hold a passage of it, and the longest passage."""
    found = leakage.leaks(src.table(s, d, "documents"), src.table(s, d, "eval_item"), least_words=12)
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("documents"), F.max("longest").alias("longest"))


def _sizes(s: SparkSession, d: str) -> DataFrame:
    return mixing.token_counts(src.table(s, d, "documents"), "doc_id", "source")


def p8_found(s: SparkSession, d: str) -> DataFrame:
    """Sources that can't reach their share, read off the mix of the cube method.

    Such a source has every document in the mix as often as it may be, and still falls short of what it should have.
    """
    sizes = cut(_sizes(s, d), "sizes")
    plan = mixing.mix_plan(sizes, src.table(s, d, "mix_target"))
    return mixing.mix_report(mixing.mix(sizes, plan), plan).where("exhausted AND falls_short").select("source")


def p8_mix(s: SparkSession, d: str) -> DataFrame:
    """How often each document goes into the mix."""
    sizes = cut(_sizes(s, d), "sizes")
    return mixing.mix(sizes, mixing.mix_plan(sizes, src.table(s, d, "mix_target")))


def p8_report(s: SparkSession, d: str) -> DataFrame:
    """Target and reached share of each source of the mix."""
    sizes = cut(_sizes(s, d), "sizes")
    plan = mixing.mix_plan(sizes, src.table(s, d, "mix_target"))
    return mixing.mix_report(mixing.mix(sizes, plan), plan).drop("exhausted", "falls_short")


def _abuse(s: SparkSession, d: str) -> DataFrame:
    docs = src.table(s, d, "documents")
    return abuse.abuse_scores(docs, abuse.train(docs, src.table(s, d, "doc_label")), "doc_id", "source")


def p9_scores(s: SparkSession, d: str) -> DataFrame:
    """Expected severity of every document's worst passage, and whether it comes out for review."""
    return _abuse(s, d).select("doc_id", F.round("severity", 6).alias("severity"), F.round("chance", 6).alias("chance"), "flagged")


def p9_rates(s: SparkSession, d: str) -> DataFrame:
    """Rates of flagged documents per source."""
    return abuse.rates(_abuse(s, d))


def p9_found(s: SparkSession, d: str) -> DataFrame:
    return _abuse(s, d).where("flagged").select("doc_id")


QUERIES: dict[str, Query] = {
    "p1_found": p1_found,
    "p1_terms": p1_terms,
    "p2_found": p2_found,
    "p3_found": p3_found,
    "p3_pairs": p3_pairs,
    "p4_found": p4_found,
    "p4_scores": p4_scores,
    "p5_found": p5_found,
    "p5_surprise": p5_surprise,
    "p7_found": p7_found,
    "p7_tiles": p7_tiles,
    "p7_items": p7_items,
    "p8_found": p8_found,
    "p8_mix": p8_mix,
    "p8_report": p8_report,
    "p9_found": p9_found,
    "p9_scores": p9_scores,
    "p9_rates": p9_rates,
}

_WORDS = f"{REVIEWS}, occ AS (SELECT rid, b, u, unnest({TERMS}) AS term FROM rev)"
_P1 = f"""WITH {_WORDS}, t AS (SELECT term, count(*) AS occurrences, count(DISTINCT rid) AS records FROM occ GROUP BY 1),
m AS (SELECT *, CASE WHEN records * 10 >= (SELECT count(*) FROM rev) THEN 'common' WHEN records <= 2 THEN 'rare' END AS mark FROM t)"""
_EDGES = "e AS (SELECT DISTINCT b, u FROM rev WHERE b IS NOT NULL AND u IS NOT NULL), n AS (SELECT b, count(*) AS n FROM e GROUP BY 1)"
_COMMON = "c AS (SELECT x.b AS b1, y.b AS b2, count(*) AS c FROM e x JOIN e y USING (u) WHERE x.b < y.b GROUP BY 1, 2), p AS (SELECT c.*, n1.n AS n1, n2.n AS n2 FROM c JOIN n n1 ON n1.b = b1 JOIN n n2 ON n2.b = b2)"
_COUNTS = f"""{_WORDS}, {STOP}, k AS (SELECT b, term, count(*) AS k FROM occ WHERE b IS NOT NULL AND term NOT IN (SELECT word FROM stop) GROUP BY 1, 2),
s AS (SELECT b, sum(k) AS n FROM k GROUP BY 1), t AS (SELECT term, count(*) AS d, sum(k) AS a FROM k GROUP BY 1)"""

# The words of a text; of the entities, those that occur in the test tables.
_FULL = "".join(map(chr, range(0xFF01, 0xFF5F)))
_HALF = "".join(map(chr, range(0x21, 0x7F))).replace("'", "''")
_TAGS = r"regexp_replace(regexp_replace(text, '</?(?:a|abbr|b|big|cite|code|em|font|i|mark|small|span|strong|sub|sup|u|wbr)(?:\s[^<>]*)?/?>', '', 'gi'), '<!--.*?-->|<[/!?]?[a-zA-Z][^<>]*>', ' ', 'gs')"
_TEXT = f"""replace(replace(replace(replace(replace({_TAGS}, '&nbsp;', ' '), '&quot;', ' '), '&lt;', ' '), '&gt;', ' '), '&amp;', ' ')"""
_PLAIN = rf"""regexp_extract_all(lower(strip_accents(translate(regexp_replace({_TEXT}, '[\p{{Cf}}\p{{M}}]', '', 'g'), '{_FULL}', '{_HALF}'))), '[\p{{L}}\p{{N}}]+')"""
_GRAMS = "SELECT {0}, unnest(range(len(w) - 11)) AS at, unnest(list_transform(range(len(w) - 11), lambda i: array_to_string(w[i + 1 : i + 12], ' '))) AS gram FROM (SELECT {0}, {1} AS w FROM {2}) WHERE len(w) >= 12"
_HITS = f"""WITH x AS ({_GRAMS.format("doc_id", _PLAIN, "documents")}), y AS ({_GRAMS.format("item_id", _PLAIN, "eval_item")}),
h AS (SELECT doc_id, item_id, x.at AS i, x.at - y.at AS diagonal FROM x JOIN y USING (gram))"""

SQL: dict[str, str] = {
    "p1_found": f"{_P1} SELECT term, mark FROM m WHERE mark IS NOT NULL",
    "p1_terms": f"{_P1} SELECT term, occurrences, records, mark FROM m",
    "p2_found": f"""WITH {_WORDS}, {STOP}, g AS (SELECT 'business' AS group_kind, b AS group_id, rid, term FROM occ WHERE b IS NOT NULL UNION ALL SELECT 'user', u, rid, term FROM occ WHERE u IS NOT NULL),
f AS (SELECT group_kind, group_id, term, count(DISTINCT rid) AS n FROM g WHERE term NOT IN (SELECT word FROM stop) GROUP BY ALL)
SELECT group_kind, group_id, term FROM f QUALIFY row_number() OVER (PARTITION BY group_kind, group_id ORDER BY n DESC, term) <= 5""",
    "p3_found": f"WITH {REVIEWS}, {_EDGES}, {_COMMON} SELECT b1, b2 FROM p WHERE n1 >= 3 AND n2 >= 3 AND c * 2 >= n1 + n2 - c",
    "p3_pairs": f"""WITH {REVIEWS}, {_EDGES}, s AS (SELECT b, list(u ORDER BY u) AS us, count(*) AS n FROM e GROUP BY 1 HAVING count(*) >= 3),
k AS (SELECT us, any_value(n) AS n, min(b) AS name, count(*) AS businesses FROM s GROUP BY 1), f AS (SELECT name, unnest(us) AS u FROM k),
c AS (SELECT x.name AS class1, y.name AS class2, count(*) AS c FROM f x JOIN f y USING (u) WHERE x.name < y.name GROUP BY 1, 2)
SELECT class1, class2, p.businesses AS businesses1, q.businesses AS businesses2, round(c::DOUBLE / (p.n + q.n - c), 6) AS sim
FROM c JOIN k p ON p.name = class1 JOIN k q ON q.name = class2 WHERE c * 2 >= p.n + q.n - c
UNION ALL SELECT name, name, businesses, businesses, 1.0::DOUBLE FROM k WHERE businesses > 1""",
    "p4_found": f"""WITH {_COUNTS} SELECT b AS business_id, term FROM k JOIN s USING (b) JOIN t USING (term)
WHERE k >= 3 AND k / n::DOUBLE * log2((SELECT count(DISTINCT nullif(trim(business_id), '')) FROM train_review)::DOUBLE / d) >= 0.0517::DOUBLE""",
    "p4_scores": f"""WITH {_COUNTS}, al AS (SELECT sum(n)::DOUBLE AS total FROM s),
z AS (SELECT b, term, k, n, a, a * 1000.0::DOUBLE / total AS prior, total FROM k JOIN s USING (b) JOIN t USING (term), al),
o AS (SELECT b, term, k, ln(k + prior) - ln(greatest(n + 1000 - k - prior, 1e-9)) - (ln(a - k + prior) - ln(greatest(total - n + 1000 - (a - k) - prior, 1e-9))) AS gap,
sqrt(1 / (k + prior) + 1 / (a - k + prior)) AS error FROM z)
SELECT b AS business_id, term, k, round(gap / error, 4) AS z, round(gap / error, 4) >= 3 AS outstanding FROM o""",
    "p5_found": f"WITH {REVIEWS}, {_EDGES}, {_COMMON} SELECT b1, b2 FROM p WHERE c >= 5 AND c * (SELECT count(DISTINCT u) FROM rev WHERE b IS NOT NULL) >= 3 * n1 * n2",
    "p7_found": f"{_HITS} SELECT DISTINCT doc_id, item_id FROM h",
    "p7_items": f"""{_HITS}, r AS (SELECT *, i - row_number() OVER (PARTITION BY doc_id, item_id, diagonal ORDER BY i) AS run FROM h),
l AS (SELECT doc_id, item_id, count(*) + 11 AS longest FROM r GROUP BY doc_id, item_id, diagonal, run)
SELECT item_id, count(DISTINCT doc_id) AS documents, CAST(max(longest) AS INTEGER) AS longest FROM l GROUP BY 1""",
    # Sizes in characters: no source is near its limit, so the tokenizer doesn't matter.
    "p8_found": """WITH g AS (SELECT lower(trim(source)) AS source, sum(target_share) AS t, max(max_repeats) AS m FROM mix_target GROUP BY 1),
h AS (SELECT lower(trim(source)) AS source, sum(length(text)) AS n FROM documents GROUP BY 1)
SELECT source FROM g LEFT JOIN h USING (source) WHERE coalesce(n, 0) * m < t * (SELECT sum(length(text)) FROM documents)""",
}
