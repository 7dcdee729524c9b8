"""Named queries over the driver tables and, where SQL can say the same, their oracles.

Every query runs over whole tables. `SQL` strings are for DuckDB with the tables as views.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rillstone.functions import minhash
from rillstone.functions.text import all_terms
from rillstone.functions.similarity import positional_cosine
from rillstone.operators import predict, profiles, setsim, skew
from rillstone.operators import ratings as rate
from rillstone.plans import workflows
from rillstone.plans.cut import cut, new_path
from rillstone.sources import reviews as src
from rillstone.sources import sinks

Query = Callable[[SparkSession, str], DataFrame]


def _ratings(s: SparkSession, d: str) -> DataFrame:
    return src.ratings(src.table(s, d, "train_review"))


def _audiences(s: SparkSession, d: str) -> DataFrame:
    return setsim.incidence(src.reviewed(src.table(s, d, "train_review")), "item", "user")


def _baskets(s: SparkSession, d: str) -> DataFrame:
    return setsim.incidence(src.reviewed(src.table(s, d, "train_review")), "user", "item")


def _tf_parts(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Term frequencies, words per document, document frequencies; texts are read and split once."""
    stop = src.stopwords(src.table(s, d, "stopword"))
    raw = src.table(s, d, "train_review")
    tf = cut(profiles.term_freq(profiles.tokens(src.documents(raw, "text"), stop)), "tf")
    return tf, profiles.doc_word_counts(tf, src.documents(raw)), profiles.doc_freq(tf)


def _item_scores(s: SparkSession, d: str) -> DataFrame:
    tf, counts, dfs = _tf_parts(s, d)
    return profiles.top_words(profiles.tfidf(tf, counts, profiles.frequent_words(dfs, counts)))


def _user_words(s: SparkSession, d: str, mode: str) -> DataFrame:
    return profiles.user_words(_ratings(s, d), _item_scores(s, d), mode)


def _test(s: SparkSession, d: str) -> DataFrame:
    return src.test_pairs(src.table(s, d, "test_review"))


def _averages(s: SparkSession, d: str) -> DataFrame:
    return src.user_averages(src.table(s, d, "user_avg"))


def _test_profiles(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(id, words) of the users and of the items of the test pairs. Users' words come from all items, for these users only."""
    test = cut(_test(s, d), "test")
    shelf = profiles.shelved_profiles(_item_scores(s, d))
    asked = _ratings(s, d).join(test.select("user").distinct(), "user", "left_semi")
    users = profiles.user_arrays(asked, shelf)
    items = shelf.table(s).join(test.select("item").distinct(), "item", "left_semi")
    return cut(users, "users"), cut(items.select(F.col("item").alias("id"), F.sort_array("words").alias("words")), "words")


def _profile_scores(s: SparkSession, d: str, kernel: str) -> DataFrame:
    return profiles.score_pairs(_test(s, d), *_test_profiles(s, d), kernel)


def _lsh(s: SparkSession, d: str, parameters: tuple) -> DataFrame:
    family, hashes, bands, first = parameters
    return setsim.lsh_pairs(_audiences(s, d), 0.05, family, hashes, bands, first)


def _band_keys(s: SparkSession, d: str) -> DataFrame:
    family, hashes, bands, first = minhash.SUBMITTED
    return setsim.band_keys(setsim.signatures(_audiences(s, d), family, hashes, first), bands, hashes // bands)


def _signature_rows(s: SparkSession, d: str) -> DataFrame:
    family, hashes, _, first = minhash.SUBMITTED
    sigs = setsim.signatures(_audiences(s, d), family, hashes, first)
    return sigs.select("key", F.posexplode("sig").alias("i", "h")).select("key", (F.col("i") + first).alias("i"), "h")


def _vector_cosine(s: SparkSession, d: str) -> DataFrame:
    """Each vector against the next one by id."""
    v = src.table(s, d, "embeddings").select("vec_id", "embedding")
    w = v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    return v.join(w, "vec_id").select("vec_id", F.round(positional_cosine(F.col("embedding"), F.col("other")), 5).alias("sim"))


def _merged_signatures(s: SparkSession, d: str) -> DataFrame:
    """Signatures of the merged profiles of the test users and items, under the parameters of merged search."""
    family, hashes, _, first = minhash.MERGED
    merged = profiles.merged_profiles(*_test_profiles(s, d))
    sigs = setsim.signatures(merged.select(F.col("id").alias("key"), F.explode("words").alias("member")), family, hashes, first)
    return sigs.select("key", F.posexplode("sig").alias("i", "h")).select("key", (F.col("i") + first).alias("i"), "h")


def _map_argmax(s: SparkSession, d: str) -> DataFrame:
    cells = src.table(s, d, "lineitem").groupBy(F.col("l_returnflag").alias("k1"), F.col("l_linestatus").alias("k2")).agg(F.count(F.lit(1)).alias("v"))
    inner = cells.groupBy("k1").agg(F.map_from_entries(F.collect_list(F.struct("k2", "v"))).alias("inner"))
    maps = inner.agg(F.map_from_entries(F.collect_list(F.struct("k1", "inner"))).alias("m"))
    return profiles.map_argmax(maps, "m")


def p6_found(s: SparkSession, d: str) -> DataFrame:
    """The businesses and users that hold at least one hundredth of all rows."""
    raw = src.table(s, d, "train_review").select(*[src.blank_to_null(c).alias(c) for c in ("business_id", "user_id")])
    one = [
        skew.heavy_keys(raw, c, 0.01).select(F.lit(c).alias("key_field"), F.col("key").alias("key_value")) for c in ("business_id", "user_id")
    ]
    return one[0].unionByName(one[1])


def p6_user_gap(s: SparkSession, d: str) -> DataFrame:
    """Per user: rows, rated rows, and the mean gap of their stars from the stored average, by the balanced join."""
    raw = src.table(s, d, "train_review").select(src.blank_to_null("user_id").alias("user"), "stars", src.blank_to_null("review_id").alias("review_id"), "loaded_at")
    plan = skew.plan_tasks(raw, "user")
    joined = skew.balanced_join(raw.where("user IS NOT NULL"), _averages(s, d), "user", "left", plan)
    cents = F.round(F.col("stars") * 100).cast("long")
    parts = joined.groupBy("user").agg(
        F.count(F.lit(1)).alias("rows"), F.count("stars").alias("rated"), F.sum(cents).alias("cents"), F.max("avg_stars").alias("avg_stars")
    )
    gap = F.round(F.try_divide(F.col("cents"), F.col("rated")) / 100 - F.col("avg_stars"), 6)
    return parts.select("user", "rows", "rated", gap.alias("gap"))


def p6_business_rows(s: SparkSession, d: str) -> DataFrame:
    """Per business: rows, rated rows and the sum of their stars in hundredths, by the balanced aggregate."""
    raw = src.table(s, d, "train_review").select(src.blank_to_null("business_id").alias("item"), "stars", "review_id", "loaded_at")
    cents = F.round(F.col("stars") * 100).cast("long")
    partial = {"n": F.count(F.lit(1)), "r": F.count("stars"), "c": F.sum(cents)}
    return skew.balanced_aggregate(raw, "item", partial, {"rows": F.sum("n"), "rated": F.sum("r"), "cents": F.sum("c")})


def _files(s: SparkSession, d: str) -> dict[str, str]:
    """The tables as the files the workflows start from, and paths for what they write."""
    at = {k: new_path(s, k) for k in ("reviews", "test", "stop", "averages", "model", "out")}
    src.table(s, d, "train_review").drop("loaded_at").write.json(at["reviews"], compression=sinks.PACKED)
    sinks.write_ndjson(src.table(s, d, "test_review"), at["test"], ("user_id", "business_id"))
    src.table(s, d, "stopword").select(F.coalesce("word", F.lit("")).alias("value")).write.text(at["stop"])
    sinks.write_averages(_averages(s, d), at["averages"])
    return at


def _ndjson(s: SparkSession, d: str, read: Callable[[SparkSession, str], DataFrame]) -> DataFrame:
    path = new_path(s, "reviews")
    src.table(s, d, "train_review").drop("loaded_at").write.json(path)
    return read(s, path)


def _tokens(s: SparkSession, d: str) -> DataFrame:
    """The terms of every review, with their place in the text."""
    texts = src.distinct_reviews(src.table(s, d, "train_review"), "text")
    return texts.select("review_id", F.posexplode(all_terms("text")).alias("at", "word"))


def _averages_file(s: SparkSession, d: str) -> DataFrame:
    path = new_path(s, "averages")
    sinks.write_averages(_averages(s, d), path)
    return src.read_averages(s, path)


def _pairs_file(s: SparkSession, d: str) -> DataFrame:
    at = _files(s, d)
    workflows.similar_items(s, at["reviews"], at["out"])
    return workflows.read_result(s, at["out"], sinks.ITEM_PAIRS)


def _model_file(s: SparkSession, d: str) -> DataFrame:
    """Every (kind, id, word) of the trained model of lines, and its word index."""
    at = _files(s, d)
    workflows.train_profiles(s, at["reviews"], at["stop"], at["model"])
    words = sinks.read_model_lines(s, at["model"]).select("kind", "id", F.explode("words").alias("word"))
    index = sinks.read_model_index(s, at["model"]).select(F.lit("word_index").alias("kind"), F.col("index").cast("string").alias("id"), "word")
    return words.unionByName(index)


def _model_tables(s: SparkSession, d: str) -> DataFrame:
    """Item profiles through a model of Parquet tables and through one JSON object per profile."""
    tables, lines = new_path(s, "model"), new_path(s, "model")
    prof = profiles.as_arrays(_item_scores(s, d), "item")
    sinks.write_model({"bprofile": prof}, tables)
    sinks.write_model_ndjson(sinks.read_model(s, tables, "bprofile")["bprofile"].withColumn("kind", F.lit("bprofile")), lines)
    return sinks.read_model_ndjson(s, lines).select("kind", "id", F.explode("words").alias("word"))


def _scores_file(s: SparkSession, d: str) -> DataFrame:
    at = _files(s, d)
    workflows.train_profiles(s, at["reviews"], at["stop"], at["model"])
    workflows.score_profiles(s, at["test"], at["model"], at["out"])
    return workflows.read_result(s, at["out"], sinks.SCORES)


def _predictions_file(s: SparkSession, d: str, of: str) -> DataFrame:
    at = _files(s, d)
    workflows.train_weights(s, at["reviews"], at["model"], of)
    workflows.predict_ratings(s, at["reviews"], at["test"], at["model"], at["out"], of, at["averages"])
    return workflows.read_result(s, at["out"], sinks.PREDICTIONS)


QUERIES: dict[str, Query] = {
    "ndjson_reviews": lambda s, d: _ndjson(s, d, src.read_ndjson),
    "ndjson_reviews_as_text": lambda s, d: _ndjson(s, d, src.read_ndjson_as_text),
    "averages_file": _averages_file,
    "similar_items_file": _pairs_file,
    "model_file": _model_file,
    "model_tables": _model_tables,
    "profile_scores_file": _scores_file,
    "item_predictions_file": lambda s, d: _predictions_file(s, d, "item"),
    "user_predictions_file": lambda s, d: _predictions_file(s, d, "user"),
    "tokens": _tokens,
    "item_audience_size": lambda s, d: setsim.set_sizes(_audiences(s, d)),
    "exact_jaccard_items": lambda s, d: setsim.exact_pairs(_audiences(s, d)),
    "exact_jaccard_users": lambda s, d: setsim.exact_pairs(_baskets(s, d)),
    "minhash_signatures": _signature_rows,
    "lsh_candidates": lambda s, d: setsim.candidates(_band_keys(s, d)),
    "lsh_similar_items": lambda s, d: _lsh(s, d, minhash.SUBMITTED),
    "lsh_short_prime_similar_items": lambda s, d: _lsh(s, d, minhash.SHORT_PRIME),
    "lsh_buckets_similar_items": lambda s, d: _lsh(s, d, minhash.BUCKETS),
    "lsh_r2_similar_items": lambda s, d: _lsh(s, d, minhash.TWO_ROWS),
    "rating_means": lambda s, d: rate.rating_means(_ratings(s, d)).withColumn("r", F.round("r", 6)),
    "support_ge3_users": lambda s, d: setsim.set_sizes(_baskets(s, d)).where("n >= 3"),
    "support_ge3_items": lambda s, d: setsim.set_sizes(_audiences(s, d)).where("n >= 3"),
    "common_raters_ge3_items": lambda s, d: setsim.common_members(setsim.supported(_audiences(s, d)), 3),
    "pearson_items": lambda s, d: rate.item_weights(_ratings(s, d)),
    "pearson_users": lambda s, d: rate.user_weights(_ratings(s, d)),
    "predict_item_based": lambda s, d: predict.predict_item_based(r := _ratings(s, d), rate.item_weights(r), _test(s, d), both=True),
    "predict_user_based_compat": lambda s, d: predict.predict_user_average(_ratings(s, d), _averages(s, d), _test(s, d)),
    "predict_user_based_intended": lambda s, d: predict.predict_user_based(r := _ratings(s, d), rate.user_weights(r), _averages(s, d), _test(s, d)),
    "user_averages": lambda s, d: src.averages_of(_ratings(s, d)).withColumn("avg_stars", F.round("avg_stars", 6)),
    "doc_word_counts": lambda s, d: _tf_parts(s, d)[1],
    "term_freq": lambda s, d: _tf_parts(s, d)[0],
    "doc_freq": lambda s, d: _tf_parts(s, d)[2],
    "rare_word_filter": lambda s, d: profiles.frequent_words((p := _tf_parts(s, d))[2], p[1]),
    "word_index": lambda s, d: sinks.word_index(_tf_parts(s, d)[2]),
    "tfidf_top200": lambda s, d: _item_scores(s, d).withColumn("score", F.round("score", 6)),
    "tfidf_smoothed": lambda s, d: profiles.tfidf_smoothed(*_tf_parts(s, d)).withColumn("score", F.round("score", 6)),
    "user_profiles_intended": lambda s, d: _user_words(s, d, "intended"),
    "user_profiles_compat": lambda s, d: _user_words(s, d, "compat"),
    "binary_cosine": lambda s, d: _profile_scores(s, d, "cosine"),
    "containment": lambda s, d: _profile_scores(s, d, "containment"),
    "vector_cosine": _vector_cosine,
    "merged_profile_pairs": lambda s, d: profiles.merged_pairs(*_test_profiles(s, d)),
    "merged_profile_signatures": _merged_signatures,
    "nested_map_argmax": _map_argmax,
    "p6_found": p6_found,
    "p6_user_gap": p6_user_gap,
    "p6_business_rows": p6_business_rows,
}

# Parts of the SQL strings.
REVIEWS = """rev AS (SELECT nullif(trim(review_id), '') AS rid, min(nullif(trim(user_id), '')) AS u, min(nullif(trim(business_id), '')) AS b,
  min(stars) AS stars, min(text) AS text FROM train_review WHERE nullif(trim(review_id), '') IS NOT NULL GROUP BY 1),
rat AS (SELECT u AS usr, b AS item, stars FROM rev WHERE u IS NOT NULL AND b IS NOT NULL)"""
NOT_A_TERM = r"""[\t\n\x0B\f\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}'',.()\\/_\-!:;#@%^&*{}\[\]+=~?"№]+"""
TERMS = f"""list_filter(string_split_regex(lower(regexp_replace(text, '[0-9]', '', 'g')), '{NOT_A_TERM}'), lambda w: length(w) > 2)"""
STOP = r"""stop AS (SELECT DISTINCT lower(regexp_replace(word, '^\s+|\s+$', '', 'g')) AS word FROM stopword WHERE word IS NOT NULL)"""
TF = f"""{REVIEWS}, {STOP},
occ AS (SELECT b AS item, unnest({TERMS}) AS word FROM rev WHERE b IS NOT NULL),
tf AS (SELECT item, word, count(*) AS tf FROM occ WHERE word NOT IN (SELECT word FROM stop) GROUP BY 1, 2),
items AS (SELECT DISTINCT b AS item FROM rev WHERE b IS NOT NULL),
cnt AS (SELECT item, CAST(coalesce(sum(tf), 0) AS BIGINT) AS n_words FROM items LEFT JOIN tf USING (item) GROUP BY 1),
dfs AS (SELECT word, count(*) AS df FROM tf GROUP BY 1),
kept AS (SELECT word, df FROM dfs WHERE df >= (SELECT sum(n_words)::DOUBLE FROM cnt) * 0.0001::DOUBLE)"""
SCORES = f"""{TF},
sc AS (SELECT item, word, round(tf / n_words::DOUBLE * log2((SELECT count(*) FROM cnt)::DOUBLE / df), 9) AS score FROM tf JOIN kept USING (word) JOIN cnt USING (item)),
prof AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY item ORDER BY score DESC, word) <= 200)"""
USERS = f"""{SCORES},
uw AS (SELECT usr, word, round(sum(score), 6) AS score, count(*) AS times FROM rat JOIN prof USING (item) GROUP BY 1, 2),
up AS (SELECT usr, word FROM uw QUALIFY row_number() OVER (PARTITION BY usr ORDER BY score DESC, word) <= 200)"""
TEST = """test AS (SELECT row_number() OVER () AS tid, nullif(trim(user_id), '') AS usr, nullif(trim(business_id), '') AS item FROM test_review
  WHERE nullif(trim(user_id), '') IS NOT NULL AND nullif(trim(business_id), '') IS NOT NULL),
av AS (SELECT nullif(trim(user_id), '') AS usr, avg_stars FROM user_avg WHERE nullif(trim(user_id), '') IS NOT NULL AND avg_stars IS NOT NULL)"""
# Every pair of merged profiles is looked at here, without buckets.
MERGED = """ti AS (SELECT item, word FROM prof WHERE item IN (SELECT item FROM test)), tu AS (SELECT usr, word FROM up WHERE usr IN (SELECT usr FROM test)),
inc AS (SELECT item AS key, word AS member, true AS is_item FROM ti UNION ALL SELECT usr, word, false FROM tu WHERE usr NOT IN (SELECT item FROM ti))"""
CELLS = """cells AS (SELECT usr, item, avg(stars) AS r FROM rat WHERE stars IS NOT NULL GROUP BY 1, 2)"""


def _pairs_sql(key: str, member: str) -> str:
    return f"""inc AS (SELECT DISTINCT {key} AS key, {member} AS member FROM rat),
siz AS (SELECT key, count(*) AS n FROM inc GROUP BY 1),
com AS (SELECT x.key AS k1, y.key AS k2, count(*) AS c FROM inc x JOIN inc y USING (member) WHERE x.key < y.key GROUP BY 1, 2),
jac AS (SELECT k1, k2, c, c::DOUBLE / (p.n + q.n - c) AS sim FROM com JOIN siz p ON p.key = k1 JOIN siz q ON q.key = k2)"""


def _pearson_sql(key: str, member: str) -> str:
    return f"""{CELLS},
sup AS (SELECT {key} AS key, count(*) AS n FROM cells GROUP BY 1 HAVING count(*) >= 3),
cel AS (SELECT {key} AS key, {member} AS member, r, n FROM cells JOIN sup ON sup.key = cells.{key}),
sums AS (SELECT x.key AS k1, y.key AS k2, count(*)::DOUBLE AS c, sum(x.r) AS sa, sum(y.r) AS sb, sum(x.r * x.r) AS saa, sum(y.r * y.r) AS sbb, sum(x.r * y.r) AS sab,
  count(*)::DOUBLE / (min(x.n) + min(y.n) - count(*)) AS jac FROM cel x JOIN cel y USING (member) WHERE x.key < y.key GROUP BY 1, 2 HAVING count(*) >= 3),
pea AS (SELECT k1, k2, jac, round(CASE WHEN c * saa - sa * sa < 1e-9 OR c * sbb - sb * sb < 1e-9 THEN 0 ELSE
  (c * sab - sa * sb) / (sqrt(greatest(c * saa - sa * sa, 0)) * sqrt(greatest(c * sbb - sb * sb, 0)) + c * 1e-10) END, 6) + 0.0::DOUBLE AS sim FROM sums)"""


def _lsh_sql(parameters: tuple, tail: str) -> str:
    f, hashes, bands, first = parameters
    r = hashes // bands
    return f"""WITH {REVIEWS}, {_pairs_sql("item", "usr")},
ids AS (SELECT member, row_number() OVER (ORDER BY member) - 1 AS x FROM (SELECT DISTINCT member FROM inc)),
base AS (SELECT key, ({f.a} * x + {f.b}) % {f.m} + ({f.a} * x + {f.b}) % {f.p} % {f.m} AS t FROM inc JOIN ids USING (member)),
sig AS (SELECT key, i, min((i * t + i * i) % {f.p} % {f.m}) AS h FROM base, (SELECT unnest(range({first}, {first + hashes})) AS i) GROUP BY 1, 2),
ban AS (SELECT key, (i - {first}) // {r} AS band, list(h ORDER BY i) AS slice FROM sig GROUP BY 1, 2),
cand AS (SELECT DISTINCT x.key AS k1, y.key AS k2 FROM ban x JOIN ban y USING (band, slice) WHERE x.key < y.key) {tail}"""


_VERIFIED = "SELECT k1, k2, sim FROM cand JOIN jac USING (k1, k2) WHERE sim >= 0.05::DOUBLE"
_KERNEL_SQL = """ , ua AS (SELECT usr, list(word) AS uw FROM up GROUP BY 1), ia AS (SELECT item, list(word) AS iw FROM prof GROUP BY 1),
s AS (SELECT usr, item, round({}, 6) AS sim FROM test JOIN ua USING (usr) JOIN ia USING (item)) SELECT usr AS "user", item, sim FROM s WHERE sim >= 0.01::DOUBLE"""

SQL: dict[str, str] = {
    "item_audience_size": f"WITH {REVIEWS}, {_pairs_sql('item', 'usr')} SELECT key, n FROM siz",
    "exact_jaccard_items": f"WITH {REVIEWS}, {_pairs_sql('item', 'usr')} SELECT k1, k2, sim FROM jac WHERE sim >= 0.05::DOUBLE",
    "exact_jaccard_users": f"WITH {REVIEWS}, {_pairs_sql('usr', 'item')} SELECT k1, k2, sim FROM jac WHERE sim >= 0.05::DOUBLE",
    "minhash_signatures": _lsh_sql(minhash.SUBMITTED, "SELECT key, i, h FROM sig"),
    "lsh_candidates": _lsh_sql(minhash.SUBMITTED, "SELECT k1, k2 FROM cand"),
    "lsh_similar_items": _lsh_sql(minhash.SUBMITTED, _VERIFIED),
    "lsh_short_prime_similar_items": _lsh_sql(minhash.SHORT_PRIME, _VERIFIED),
    "lsh_buckets_similar_items": _lsh_sql(minhash.BUCKETS, _VERIFIED),
    "lsh_r2_similar_items": _lsh_sql(minhash.TWO_ROWS, _VERIFIED),
    "rating_means": f'WITH {REVIEWS}, {CELLS} SELECT usr AS "user", item, round(r, 6) AS r FROM cells',
    "support_ge3_users": f"WITH {REVIEWS}, {_pairs_sql('usr', 'item')} SELECT key, n FROM siz WHERE n >= 3",
    "support_ge3_items": f"WITH {REVIEWS}, {_pairs_sql('item', 'usr')} SELECT key, n FROM siz WHERE n >= 3",
    "common_raters_ge3_items": f"WITH {REVIEWS}, {_pairs_sql('item', 'usr')} SELECT k1, k2, c FROM com WHERE c >= 3",
    "pearson_items": f"WITH {REVIEWS}, {_pearson_sql('item', 'usr')} SELECT k1 AS b1, k2 AS b2, sim FROM pea WHERE sim > 0 UNION ALL SELECT k2, k1, sim FROM pea WHERE sim > 0",
    "pearson_users": f"WITH {REVIEWS}, {_pearson_sql('usr', 'item')} SELECT k1 AS u1, k2 AS u2, sim FROM pea WHERE jac >= 0.01::DOUBLE",
    "predict_item_based": f"""WITH {REVIEWS}, {_pearson_sql("item", "usr")}, {TEST},
w AS (SELECT k1, k2, sim FROM pea WHERE sim > 0),
nei AS (SELECT tid, t.usr, t.item, o.item AS other, c.r, coalesce(sim, 0) AS w FROM test t JOIN rat o ON o.usr = t.usr AND o.stars IS NOT NULL
  JOIN cells c ON c.usr = o.usr AND c.item = o.item LEFT JOIN w ON k1 = least(t.item, o.item) AND k2 = greatest(t.item, o.item)),
best AS (SELECT * FROM nei QUALIFY row_number() OVER (PARTITION BY tid ORDER BY w DESC, other) <= 2)
SELECT usr AS "user", item, round(sum(r * w) / sum(abs(w)), 6) AS stars FROM best GROUP BY tid, usr, item HAVING sum(abs(w)) > 0""",
    "predict_user_based_compat": f"""WITH {REVIEWS}, {TEST}
SELECT usr AS "user", item, CASE WHEN item IN (SELECT item FROM rat) THEN avg_stars END AS stars FROM test LEFT JOIN av USING (usr)""",
    "predict_user_based_intended": f"""WITH {REVIEWS}, {_pearson_sql("usr", "item")}, {TEST},
w AS (SELECT k1, k2, sim FROM pea WHERE jac >= 0.01::DOUBLE),
nei AS (SELECT tid, t.usr, t.item, o.usr AS other, coalesce(sim, 0) AS w FROM test t JOIN rat o ON o.item = t.item
  LEFT JOIN w ON k1 = least(t.usr, o.usr) AND k2 = greatest(t.usr, o.usr)),
best AS (SELECT * FROM nei QUALIFY row_number() OVER (PARTITION BY tid ORDER BY w DESC, other) <= 2),
agg AS (SELECT tid, sum((c.r - av.avg_stars) * w) AS top, sum(abs(w)) AS under, count(*) FILTER (WHERE c.r IS NULL OR av.avg_stars IS NULL) AS missing
  FROM best LEFT JOIN cells c ON c.usr = other AND c.item = best.item LEFT JOIN av ON av.usr = other GROUP BY 1)
SELECT test.usr AS "user", test.item, round(CASE WHEN under IS NULL OR av.avg_stars IS NULL THEN NULL WHEN under = 0 THEN av.avg_stars
  WHEN missing > 0 THEN NULL ELSE av.avg_stars + top / under END, 6) AS stars FROM test LEFT JOIN av USING (usr) LEFT JOIN agg USING (tid)""",
    "user_averages": f'WITH {REVIEWS} SELECT usr AS "user", round(avg(stars), 6) AS avg_stars FROM rat GROUP BY 1 HAVING avg(stars) IS NOT NULL',
    "doc_word_counts": f"WITH {TF} SELECT item, n_words FROM cnt",
    "term_freq": f"WITH {TF} SELECT item, word, tf FROM tf",
    "doc_freq": f"WITH {TF} SELECT word, df FROM dfs",
    "rare_word_filter": f"WITH {TF} SELECT word, df FROM kept",
    "word_index": f'WITH {TF} SELECT word, row_number() OVER (ORDER BY word) AS "index" FROM dfs',
    "tfidf_top200": f"WITH {SCORES} SELECT item, word, round(score, 6) AS score FROM prof",
    "tfidf_smoothed": f"WITH {TF} SELECT item, word, round(round(tf / n_words::DOUBLE * ln((SELECT count(*) FROM cnt)::DOUBLE / (df + 1)), 9), 6) AS score FROM tf JOIN dfs USING (word) JOIN cnt USING (item)",
    "user_profiles_intended": f'WITH {USERS} SELECT usr AS "user", word FROM up',
    "user_profiles_compat": f"""WITH {USERS},
rep AS (SELECT usr, word FROM uw, LATERAL (SELECT unnest(range(uw.times))) AS t(i)),
top AS (SELECT * FROM rep QUALIFY row_number() OVER (PARTITION BY usr ORDER BY substring(word, 2, 1) DESC, word) <= 200) SELECT DISTINCT usr AS "user", word FROM top""",
    "binary_cosine": f"WITH {USERS}, {TEST}" + _KERNEL_SQL.format("len(list_intersect(uw, iw)) / (sqrt(len(uw)) * sqrt(len(iw)))"),
    "containment": f"WITH {USERS}, {TEST}" + _KERNEL_SQL.format("len(list_intersect(uw, iw)) / len(uw)::DOUBLE"),
    "merged_profile_pairs": f"""WITH {USERS}, {TEST}, {MERGED},
com AS (SELECT x.key AS usr, y.key AS item, count(*) AS c FROM inc x JOIN inc y USING (member) WHERE y.is_item AND NOT x.is_item GROUP BY 1, 2),
siz AS (SELECT key, count(*)::DOUBLE AS n FROM inc GROUP BY 1),
s AS (SELECT usr, item, round(c / (sqrt(p.n) * sqrt(q.n)), 6) AS sim FROM com JOIN siz p ON p.key = usr JOIN siz q ON q.key = item)
SELECT usr AS "user", item, sim FROM s WHERE sim >= 0.01::DOUBLE""",
    "merged_profile_signatures": f"""WITH {USERS}, {TEST}, {MERGED},
ids AS (SELECT member, row_number() OVER (ORDER BY member) - 1 AS x FROM (SELECT DISTINCT member FROM inc)),
base AS (SELECT key, (9679 * x + 23143) % 27351 + (9679 * x + 23143) % 502687 % 27351 AS t FROM inc JOIN ids USING (member))
SELECT key, i, min((i * t + i * i) % 502687 % 27351) AS h FROM base, (SELECT unnest(range(1, 201)) AS i) GROUP BY 1, 2""",
    "vector_cosine": """SELECT a.vec_id, round(list_dot_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) /
  (sqrt(list_dot_product(a.embedding::DOUBLE[], a.embedding::DOUBLE[])) * sqrt(list_dot_product(b.embedding::DOUBLE[], b.embedding::DOUBLE[]))), 5) AS sim
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "nested_map_argmax": "SELECT l_returnflag AS k1, l_linestatus AS k2, count(*) AS value FROM lineitem GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 1",
    "p6_found": """WITH r AS (SELECT nullif(trim(business_id), '') AS b, nullif(trim(user_id), '') AS u FROM train_review),
k AS (SELECT 'business_id' AS key_field, b AS key_value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'user_id', u, count(*) FROM r GROUP BY 2)
SELECT key_field, key_value FROM k WHERE key_value IS NOT NULL AND n * 100 >= (SELECT count(*) FROM r)""",
    "p6_user_gap": """WITH r AS (SELECT nullif(trim(user_id), '') AS u, CAST(round(stars * 100) AS BIGINT) AS cents FROM train_review),
a AS (SELECT nullif(trim(user_id), '') AS u, avg_stars FROM user_avg WHERE avg_stars IS NOT NULL)
SELECT u AS "user", count(*) AS rows, count(cents) AS rated, round(sum(cents)::DOUBLE / nullif(count(cents), 0) / 100 - max(avg_stars), 6) AS gap
FROM r LEFT JOIN a USING (u) WHERE u IS NOT NULL GROUP BY 1""",
    "p6_business_rows": """SELECT nullif(trim(business_id), '') AS item, count(*) AS rows, count(stars) AS rated, CAST(sum(CAST(round(stars * 100) AS BIGINT)) AS BIGINT) AS cents
FROM train_review WHERE nullif(trim(business_id), '') IS NOT NULL GROUP BY 1""",
}

_REVIEW_ROWS = "SELECT review_id, user_id, business_id, stars, text, date FROM train_review"
SQL |= {
    "ndjson_reviews": _REVIEW_ROWS,
    "ndjson_reviews_as_text": _REVIEW_ROWS,
    "averages_file": f'WITH {TEST} SELECT usr AS "user", avg_stars FROM av',
    "similar_items_file": SQL["lsh_similar_items"].replace("SELECT k1, k2, sim", "SELECT k1 AS b1, k2 AS b2, sim"),
    "model_file": f"""WITH {USERS} SELECT 'bprofile' AS kind, item AS id, word FROM prof UNION ALL SELECT 'uprofile', usr, word FROM up
UNION ALL SELECT DISTINCT 'ureviews', usr, item FROM rat UNION ALL SELECT 'word_index', CAST(row_number() OVER (ORDER BY word) AS VARCHAR), word FROM dfs""",
    "model_tables": f"WITH {SCORES} SELECT 'bprofile' AS kind, item AS id, word FROM prof",
    "profile_scores_file": f"SELECT \"user\" AS user_id, item AS business_id, sim FROM ({SQL['binary_cosine']})",
    "item_predictions_file": f"SELECT \"user\" AS user_id, item AS business_id, stars FROM ({SQL['predict_item_based']})",
    "user_predictions_file": f"SELECT \"user\" AS user_id, item AS business_id, stars FROM ({SQL['predict_user_based_intended']})",
    "tokens": f"WITH {REVIEWS}, t AS (SELECT rid, {TERMS} AS words FROM rev) SELECT rid AS review_id, CAST(unnest(range(len(words))) AS INTEGER) AS at, unnest(words) AS word FROM t",
}
