"""Queries over catalogs, files and requests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalogmatch.functions import spelling as SP
from catalogmatch.functions import text as T
from catalogmatch.operators import catalog as C
from catalogmatch.operators import pairing as P
from catalogmatch.operators import retrieval as R
from catalogmatch.operators.search_index import SearchIndex
from catalogmatch.plans.inputs import cte, frame, table, with_profile
from catalogmatch.sources import catalog as S
from catalogmatch.sources import files as X
from catalogmatch.sources import versions as V
from catalogmatch.sources.sinks import kept_table, nested_results, work_dir

SEARCH_SQL = "lower(concat_ws(' ', name, winery, region, grapes))"


def a2_catalog_checks(spark, sf):
    return S.checked_catalog(frame(spark, sf, "raw_catalog")).select("slug", "pos", "reason")


def a3_urls(spark, sf):
    return S.with_urls(table(spark, sf, "pages").select(F.col("page_id").alias("pos"), F.col("url").alias("slug"))).select("pos", "image_url", "source_url")


def a4_profiles(spark, sf):
    cards = frame(spark, sf, "catalog")
    lines = table(spark, sf, "lineitem").select(
        F.concat(F.lit("p-"), (F.col("l_partkey") + F.col("l_linenumber") % 3).cast("string")).alias("slug"),
        F.struct("l_quantity", "l_suppkey", "l_extendedprice").alias("profile"),
        F.when(F.col("l_linenumber") == 7, F.array(F.lit("unclear"))).otherwise(F.array().cast("array<string>")).alias("problems"),
        F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity").alias("line"),
    )
    return S.usable_profiles(lines, cards).select("slug", "profile.l_suppkey", "profile.l_extendedprice")


def _manifest(spark, sf):
    docs = table(spark, sf, "documents").select(F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("path"), F.col("doc_id"), F.encode("text", "utf-8").alias("content"))
    found = X.with_sha256(docs.where("doc_id % 7 <> 0"))
    expected = docs.where("doc_id % 11 <> 0").select("path", F.when(F.col("doc_id") % 5 == 0, F.sha2(F.lit("other").cast("binary"), 256)).otherwise(F.sha2("content", 256)).alias("sha256"))
    return expected, found


def a8_manifest(spark, sf):
    return X.manifest_status(*_manifest(spark, sf)).select("path", "status")


def a9_worklist(spark, sf):
    stored, current = (x.select(F.col("path").alias("slug"), F.col("sha256").alias("hash")) for x in _manifest(spark, sf))
    return X.worklist(current, stored)


def a10_signature(spark, sf):
    return X.corpus_signature(frame(spark, sf, "catalog").select("slug", F.concat("name", F.lit(". "), "winery").alias("text")), parts=16)


def _cards_text(spark, sf):
    return frame(spark, sf, "catalog").select("slug", "pos", F.concat("name", F.lit(". "), "winery").alias("text"))


def a10_signature_tree(spark, sf):
    """All nodes of the tree over the catalog."""
    return X.SignatureTree.of(_cards_text(spark, sf), levels=3, most=None).nodes


def a10_updated_tree(spark, sf):
    """The same nodes, from a tree over an older catalog: some texts changed, some cards were missing, some are gone since."""
    cards = _cards_text(spark, sf)
    older = cards.where("pos % 40 <> 1").withColumn("text", F.when(F.col("pos") % 50 == 2, "as it was").otherwise(F.col("text")))
    gone = cards.where("pos % 30 = 3").select(F.concat("slug", F.lit("-old")).alias("slug"), F.lit("gone").alias("text"))
    tree = X.SignatureTree.of(older.select("slug", "text").unionByName(gone), levels=3, most=None)
    return tree.updated(cards.where("pos % 40 = 1 OR pos % 50 = 2"), gone).nodes


def a9_versions(spark, sf):
    """Work lists of successive versions: all rows at first, then changes alone, nothing where nothing changed, all rows after another setting."""
    known = V.FeatureVersions(spark, work_dir(spark, "versions"))
    expected, found = (x.select(F.col("path").alias("slug"), F.col("sha256").alias("hash")) for x in _manifest(spark, sf))
    out = None
    for step, (rows, settings) in enumerate([(expected, {"size": "384"}), (found, {"size": "384"}), (found, {"size": "384"}), (found, {"size": "512"})], 1):
        todo = kept_table(known.worklist(rows, settings).withColumn("step", F.lit(step)), "worklist")
        known.commit(rows, settings)
        out = todo if out is None else out.unionByName(todo)
    return out


def a12_results(spark, sf):
    ranked = frame(spark, sf, "catalog").select(F.col("winery").alias("query_id"), "slug", F.col("pos").cast("double").alias("score"), F.row_number().over(C.Window.partitionBy("winery").orderBy(F.desc("pos"))).alias("rank"))
    return nested_results(ranked).select("query_id", F.array_join(F.transform("candidates", lambda x: F.concat(x["rank"].cast("string"), F.lit(":"), x["slug"])), ",").alias("candidates"))


def a14_image_gate(spark, sf):
    return X.gated_images(frame(spark, sf, "images")).select("l_orderkey", "l_linenumber", "l_partkey", "code", "reason")


def _queries(cards):
    return cards.select(F.concat("name", F.lit(" "), F.upper("winery")).alias("query"), F.when(F.col("pos") % 4 == 0, F.col("category")).otherwise("").alias("category")).distinct().withColumn(
        "query_id", F.concat("query", F.lit("/"), "category")
    )


QUERIES_CTE = ", queries AS (SELECT *, concat(query, '/', category) AS query_id FROM (SELECT DISTINCT concat(name, ' ', upper(winery)) AS query, CASE WHEN pos % 4 = 0 THEN category ELSE '' END AS category FROM catalog))"
FOUND_SQL = f"""
WITH {cte("catalog")}{QUERIES_CTE}, found AS (
  SELECT q.query_id, c.slug, c.pos FROM queries q JOIN catalog c
  ON (q.category = '' OR c.category = q.category)
  AND len(list_filter(string_split_regex(lower(q.query), '\\s+'), lambda w: w <> '' AND NOT contains(lower(concat_ws(' ', c.name, c.winery, c.region, c.grapes)), w))) = 0
)"""


def b2_token_search(spark, sf):
    cards = frame(spark, sf, "catalog")
    return C.token_search(cards, _queries(cards))


def b3_paging(spark, sf):
    cards = frame(spark, sf, "catalog")
    return C.paged(C.token_search(cards, _queries(cards)), offset=1, limit=3).select("query_id", "slug", "n", "total")


def _indexed(spark, sf):
    """The catalog in a stored index, written in two parts."""
    cards, rows = frame(spark, sf, "catalog"), 256
    return SearchIndex.write(cards.where("pos % 1000 < 800"), segment_rows=rows).append(cards.where("pos % 1000 >= 800"), rows)


def b2_indexed_search(spark, sf):
    return _indexed(spark, sf).search(_queries(frame(spark, sf, "catalog")))


def b3_indexed_page(spark, sf):
    """Pages of the same queries and of an empty one for every category, from the stored index."""
    cards = frame(spark, sf, "catalog")
    empty = cards.select("category").distinct().select(F.lit(None).cast("string").alias("query"), "category", F.concat(F.lit("all/"), "category").alias("query_id"))
    return _indexed(spark, sf).page(_queries(cards).unionByName(empty), offset=1, limit=3).select("query_id", "slug", "n")


def b4_lookup(spark, sf):
    cards = table(spark, sf, "customer").where("c_custkey % 10 <> 3").select(F.col("c_custkey").alias("slug"), F.col("c_name").alias("name"), "c_nationkey")
    nations = table(spark, sf, "nation").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("nation"))
    keys = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("slug"))
    return C.lookup(keys, cards).join(nations, "c_nationkey", "left").select("o_orderkey", "slug", "name", "nation", "found")


def _slugs_of_lines(spark, sf):
    return table(spark, sf, "lineitem").select(F.concat(F.lit("p-"), (F.col("l_partkey") * 3 - 50).cast("string")).alias("slug"))


LINES_CTE = "lines AS (SELECT concat('p-', CAST(l_partkey * 3 - 50 AS VARCHAR)) AS slug FROM lineitem)"


def b5_missing_photos(spark, sf):
    return C.missing_photos(frame(spark, sf, "catalog"), _slugs_of_lines(spark, sf)).select("slug")


def b6_not_in_catalog(spark, sf):
    return C.not_in_catalog(_slugs_of_lines(spark, sf), frame(spark, sf, "catalog"))


def b7_one_sided(spark, sf):
    return C.one_sided(frame(spark, sf, "catalog"), _slugs_of_lines(spark, sf))


def f2_key_difference(spark, sf):
    return C.key_difference(_slugs_of_lines(spark, sf), frame(spark, sf, "catalog"))


def b10_splits(spark, sf):
    return C.in_splits(frame(spark, sf, "predictions"), "dev", "val").select("query_id", "split")


def b12_violations(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.when(F.col("l_linenumber") != 4, F.concat("l_returnflag", F.col("l_partkey").cast("string"))).alias("slug"), (F.col("l_discount") * 15).alias("confidence"))
    checks = X.candidate_checks(F.col("slug"), F.col("confidence")) | {"few_lines": F.col("l_linenumber") <= 6, "known_flag": F.substring("slug", 1, 1).isin("A", "N")}
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join(X.violations(**checks), ",").alias("violations"))


def h21_sessions(spark, sf):
    session = F.when(F.col("user_id") % 3 == 0, F.upper(F.md5(F.col("user_id").cast("string").cast("binary")))).otherwise(F.md5(F.col("user_id").cast("string").cast("binary")))
    return table(spark, sf, "events").select("event_id", X.valid_session(session).alias("valid"))


def d1_facets(spark, sf):
    return C.facets(frame(spark, sf, "catalog")).select("total", F.array_join("categories", ",").alias("categories"), "n_wineries")


def e1_featured(spark, sf):
    return C.featured(frame(spark, sf, "catalog")).select(F.col("place").cast("int").alias("place"), "slug")


def i1_pairing(spark, sf):
    return P.recommend(frame(spark, sf, "catalog"), frame(spark, sf, "requests"))


def f4_answers_or_rules(spark, sf):
    requests = frame(spark, sf, "requests")
    answers = requests.where("request_id % 3 = 0").select("request_id", F.lit(1).alias("place"), F.lit("p-1").alias("slug"), F.lit("llm").alias("method"))
    rules = P.recommend(frame(spark, sf, "catalog"), requests).select("request_id", "place", "slug", "method")
    return P.answers_or_rules(answers, rules)


def f4_model_pairings(spark, sf):
    """Every third request is answered by a model that cites cards of the request's shortlist; the rules answer the others."""
    requests, cards = frame(spark, sf, "requests"), frame(spark, sf, "catalog")
    rules = P.recommend(cards, requests)
    answers = requests.where("request_id % 3 = 0").select("request_id", F.concat(F.lit("Берите ["), (F.col("request_id") % 4).cast("string"), F.lit("] и [2].")).alias("answer"))
    asked = answers.select(F.col("request_id").alias("question_id"), "answer", F.lit(None).cast("string").alias("about_slug"))
    shortlist = rules.where("slug IS NOT NULL").select(F.col("request_id").alias("question_id"), F.col("place").alias("position"), "slug")
    cited = R.cited_items(asked, shortlist).select(F.col("question_id").alias("request_id"), "place", "slug")
    found = P.answers_or_rules(P.answered_pairings(answers, cited, P.planned(requests)), rules.drop("note"))
    return found.withColumn("place", F.col("place").cast("int"))


def h11_pairing_question(spark, sf):
    return P.pairing_question(frame(spark, sf, "requests"))


def h6_card_text(spark, sf):
    return with_profile(frame(spark, sf, "catalog")).select("slug", T.card_text().alias("text"))


def h7_shortlist_line(spark, sf):
    return with_profile(frame(spark, sf, "catalog")).select("slug", T.shortlist_line(F.col("pos") % 6 + 1).alias("line"))


def _texts(spark, sf):
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), "text")


def h1_normalize(spark, sf):
    return _texts(spark, sf).select("id", T.normalize_text(F.col("text")).alias("text"))


def h2_ngrams(spark, sf):
    grams = T.char_ngrams(T.normalize_text(F.col("text")))
    return table(spark, sf, "benchmark").select(F.col("item_id").alias("id"), F.explode(grams).alias("gram")).groupBy("id", "gram").agg(F.count("*").alias("n"))


def h3_ngram_vectors(spark, sf):
    return T.ngram_vectors(table(spark, sf, "benchmark"), "item_id", "text").select("item_id", "bucket", F.round("value", 6).alias("value"))


def h3_blake_vectors(spark, sf):
    """As h3_ngram_vectors with exactly normalised texts and BLAKE2b buckets, which SQL does not have."""
    return T.ngram_vectors(table(spark, sf, "benchmark"), "item_id", "text", hash="blake2b", exact=True).select("item_id", "bucket", F.round("value", 6).alias("value"))


def h1_normalize_exactly(spark, sf):
    """Compatibility forms folded before the letters are spelled, which SQL does not have."""
    wide = F.concat("text", F.lit(" ﬁn Ⅻ ９ ½ "), "role")
    return table(spark, sf, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), T.normalize_exactly()(wide).alias("text"))


#: Words of other scripts and compatibility forms that the documents do not have.
WIDER = ("Ωμέγα Łódź", "ﬁn Ⅻ ９ ½ №", "かたな ｱ ꜰ", "თბილისი Ереван", "שלום ٪", "𝓪㎏ ĳ", "Việt Nam đ", "Їжак ґ")


def h1_spelled(spark, sf):
    """Whole documents, and words of other scripts, spelled in Latin letters by the full table."""
    more = F.element_at(F.array(*map(F.lit, WIDER)), (F.col("doc_id") % len(WIDER) + 1).cast("int"))
    return table(spark, sf, "documents").select("doc_id", SP.normalize_spelled(F.concat("text", F.lit(" "), more)).alias("text"))


def _spelled_sql():
    listed = ", ".join(f"('{s}', '{t.replace(chr(39), chr(39) * 2)}')" for s, t in SP.spelling_table().items() if len(s) == 1)
    more = "[" + ", ".join(f"'{w}'" for w in WIDER) + f"][doc_id % {len(WIDER)} + 1]"
    return f"""WITH letters(source, target) AS (VALUES {listed}), cut AS (SELECT doc_id, string_split(lower(concat(text, ' ', {more})), '') AS cs FROM documents),
      one AS (SELECT doc_id, unnest(cs) AS c, generate_subscripts(cs, 1) AS i FROM cut)
      SELECT doc_id, trim(regexp_replace(string_agg(coalesce(target, c), '' ORDER BY i), '[^a-z0-9]+', ' ', 'g')) AS text FROM one LEFT JOIN letters ON source = c GROUP BY doc_id"""


def _spell(x):
    out = f"translate(lower({x}), '{T.LETTERS[0]}', '{T.LETTERS[1]}')"
    for letter, spelling in T.SPELLED.items():
        out = f"replace({out}, '{letter}', '{spelling.replace(chr(39), chr(39) * 2)}')"
    return f"trim(regexp_replace({out}, '[^a-z0-9]+', ' ', 'g'))"


GRAMS_CTE = f"""texts AS (SELECT item_id AS id, concat(' ', {_spell('text')}, ' ') AS t FROM benchmark),
grams AS (SELECT id, unnest(flatten(list_transform([2, 3, 4, 5], lambda n: list_transform(range(1, greatest(1, length(t) - n + 2)), lambda i: substr(t, i, n))))) AS gram FROM texts WHERE trim(t) <> '')"""


def _known(x):
    return f"CASE WHEN {x} <> '' AND {x} <> '{T.UNKNOWN}' THEN {x} END"


CARD_SQL = f"""concat_ws(' ', concat(name, '. ', winery, '.'), concat(concat_ws(', ', category, {_known('sweetness')}, CASE WHEN sparkling THEN 'игристое' END), '.'),
concat('Регион: ', region, '. Сорт: ', grapes, '.'), CASE WHEN description <> '' THEN description END,
CASE WHEN len(aromas) > 0 THEN 'Ароматы: ' || array_to_string(aromas, ', ') || '.' END, CASE WHEN len(pairing) > 0 THEN 'Подходит к: ' || array_to_string(pairing, ', ') || '.' END)"""
LINE_SQL = f"""concat_ws(' ', '[' || CAST({{position}} AS VARCHAR) || '] ' || name || ' — ' || winery || ', ' || region || '. Сорт: ' || grapes || '. ' ||
concat_ws('; ', category, {_known('sweetness')}, 'тело ' || ({_known('body')}), 'кислотность ' || ({_known('acidity')}), 'танины ' || ({_known('tannins')}), CASE WHEN sparkling THEN 'игристое' END) || '.',
CASE WHEN len(aromas) > 0 THEN 'Ароматы: ' || array_to_string(aromas, ', ') || '.' END, CASE WHEN len(pairing) > 0 THEN 'К блюдам: ' || array_to_string(pairing, ', ') || '.' END,
CASE WHEN serve_temp <> '' AND NOT contains(serve_temp, 'неизв') THEN 'Подача: ' || serve_temp || '.' END)"""


def _values(rows, names):
    text = ", ".join("(" + ", ".join("'" + x + "'" for x in row) + ")" for row in rows)
    return f"(VALUES {text}) AS v({names})"


RULES_CTE = f"""rules AS (SELECT * FROM {_values(P.RULES, 'dish, rule_category, title, rule_text, temperature')}),
prefs AS (SELECT * FROM {_values(P.PREFERENCES, 'preference, wanted, adjective, wanted_text')}),
plan AS (
  SELECT r.request_id, r.dish, coalesce(p.wanted, u.rule_category) AS category, u.title,
         CASE WHEN p.wanted IS NOT NULL AND p.wanted <> u.rule_category THEN '{P.CHANGED}' || p.wanted_text ELSE u.rule_text END AS explanation, u.temperature
  FROM requests r JOIN rules u ON r.dish = u.dish LEFT JOIN prefs p ON r.preference = p.preference
), searches AS (SELECT DISTINCT category, dish = 'dessert' AS sweet FROM plan),
hits AS (
  SELECT s.category, s.sweet, c.slug, c.pos, row_number() OVER (PARTITION BY s.category, s.sweet, c.winery ORDER BY c.pos) AS own
  FROM searches s JOIN catalog c ON (CASE WHEN s.category = 'Игристое' THEN regexp_matches(lower(c.name), 'брют|игрист|spumante|петнат') ELSE contains(lower(c.category), lower(s.category)) END)
  AND (NOT s.sweet OR contains(lower(c.name), 'сладк'))
), top AS (SELECT *, CAST(row_number() OVER (PARTITION BY category, sweet ORDER BY pos) AS INT) AS place FROM hits WHERE own = 1),
recommended AS (
  SELECT p.request_id, t.place, t.slug, p.title, p.explanation, p.temperature, '{P.NOTE}' AS note, 'editorial_rules' AS method
  FROM plan p LEFT JOIN top t ON t.category = p.category AND t.sweet = (p.dish = 'dessert') AND t.place <= 3
)"""

QUERIES = {
    f.__name__: f
    for f in (
        a2_catalog_checks, a3_urls, a4_profiles, a8_manifest, a9_worklist, a10_signature, a10_signature_tree, a10_updated_tree, a9_versions, a12_results, a14_image_gate, b2_token_search, b3_paging, b2_indexed_search, b3_indexed_page, b4_lookup, b5_missing_photos,
        b6_not_in_catalog, b7_one_sided, f2_key_difference, b10_splits, b12_violations, h21_sessions, d1_facets, e1_featured, i1_pairing, f4_answers_or_rules, f4_model_pairings, h11_pairing_question,
        h6_card_text, h7_shortlist_line, h1_normalize, h1_spelled, h2_ngrams, h3_ngram_vectors, h3_blake_vectors, h1_normalize_exactly,
    )
}
MANIFEST_CTE = """found AS (SELECT concat('doc/', CAST(doc_id AS VARCHAR)) AS path, sha256(text) AS h FROM documents WHERE doc_id % 7 <> 0),
expected AS (SELECT concat('doc/', CAST(doc_id AS VARCHAR)) AS path, CASE WHEN doc_id % 5 = 0 THEN sha256('other') ELSE sha256(text) END AS h FROM documents WHERE doc_id % 11 <> 0)"""
ORACLES = {
    "a2_catalog_checks": f"""WITH {cte("raw_catalog")} SELECT slug, pos, CASE WHEN coalesce(slug, '') = '' THEN 'empty_slug' WHEN regexp_matches(slug, '[/\\\\]') THEN 'separator_in_slug'
      WHEN row_number() OVER (PARTITION BY slug ORDER BY pos) > 1 THEN 'repeated_slug' END AS reason FROM raw_catalog""",
    "a3_urls": "SELECT page_id AS pos, '/api/catalog/' || replace(url_encode(url), '%2F', '/') || '/image' AS image_url, 'https://example.com/items/' || replace(url_encode(url), '%2F', '/') AS source_url FROM pages",
    "a4_profiles": f"""WITH {cte("catalog")}, lines AS (SELECT concat('p-', CAST(l_partkey + l_linenumber % 3 AS VARCHAR)) AS slug, * FROM lineitem WHERE l_linenumber <> 7),
      last AS (SELECT *, row_number() OVER (PARTITION BY slug ORDER BY l_orderkey DESC, l_linenumber DESC, l_partkey DESC, l_suppkey DESC, l_extendedprice DESC, l_quantity DESC) AS n FROM lines)
      SELECT slug, l_suppkey, l_extendedprice FROM last WHERE n = 1 AND slug IN (SELECT slug FROM catalog)""",
    "a8_manifest": f"""WITH {MANIFEST_CTE} SELECT coalesce(e.path, f.path) AS path, CASE WHEN e.h IS NULL THEN 'unexpected' WHEN f.h IS NULL THEN 'missing' WHEN e.h = f.h THEN 'match' ELSE 'mismatch' END AS status
      FROM expected e FULL JOIN found f ON e.path = f.path""",
    "a9_worklist": f"""WITH {MANIFEST_CTE} SELECT path AS slug, 'recompute' AS action FROM found f WHERE NOT EXISTS (SELECT 1 FROM expected e WHERE e.path = f.path AND e.h = f.h)
      UNION ALL SELECT path, 'drop' FROM expected e WHERE NOT EXISTS (SELECT 1 FROM found f WHERE e.path = f.path)""",
    "a10_signature": f"""WITH {cte('catalog')}, r AS (SELECT slug, sha256(name || '. ' || winery) AS t, CAST('0x' || substr(md5(slug), 1, 8) AS BIGINT) % 16 AS part FROM catalog),
      d AS (SELECT part, sha256(string_agg(t, chr(10) ORDER BY slug)) AS d FROM r GROUP BY part) SELECT sha256(string_agg(d, chr(10) ORDER BY part)) AS signature FROM d""",
    "a12_results": f"""WITH {cte("catalog")}, r AS (SELECT winery, slug, row_number() OVER (PARTITION BY winery ORDER BY pos DESC) AS n FROM catalog)
      SELECT winery AS query_id, string_agg(CAST(n AS VARCHAR) || ':' || slug, ',' ORDER BY n) AS candidates FROM r WHERE n <= 20 GROUP BY winery""",
    "a14_image_gate": f"""WITH {cte("images")}, r AS (SELECT *, CASE WHEN n_bytes > 12582912 THEN 'too_many_bytes' WHEN format IS NULL THEN 'unreadable' WHEN format NOT IN ('JPEG', 'PNG', 'WEBP') THEN 'format'
      WHEN CAST(width AS BIGINT) * height > 24000000 THEN 'too_many_pixels' WHEN least(width, height) < 32 THEN 'too_small' END AS reason FROM images)
      SELECT l_orderkey, l_linenumber, l_partkey, CASE reason WHEN 'too_many_bytes' THEN 413 WHEN 'too_many_pixels' THEN 413 WHEN 'unreadable' THEN 422 WHEN 'too_small' THEN 422 WHEN 'format' THEN 415 END AS code, reason FROM r""",
    "b2_token_search": f"{FOUND_SQL} SELECT * FROM found",
    "b3_paging": f"""{FOUND_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n, count(*) OVER (PARTITION BY query_id) AS total FROM found)
      SELECT query_id, slug, n - 1 AS n, total FROM r WHERE n > 1 AND n <= 4""",
    "b4_lookup": """SELECT o.o_orderkey, o.o_custkey AS slug, c.c_name AS name, n.n_name AS nation, c.c_custkey IS NOT NULL AS found
      FROM orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey AND c.c_custkey % 10 <> 3 LEFT JOIN nation n ON c.c_nationkey = n.n_nationkey""",
    "b5_missing_photos": f"WITH {cte('catalog')}, {LINES_CTE} SELECT slug FROM catalog WHERE slug NOT IN (SELECT slug FROM lines)",
    "b6_not_in_catalog": f"WITH {cte('catalog')}, {LINES_CTE} SELECT DISTINCT slug FROM lines WHERE slug NOT IN (SELECT slug FROM catalog)",
    "b7_one_sided": f"""WITH {cte("catalog")}, {LINES_CTE} SELECT slug, 'first' AS side FROM catalog WHERE slug NOT IN (SELECT slug FROM lines)
      UNION ALL SELECT DISTINCT slug, 'second' FROM lines WHERE slug NOT IN (SELECT slug FROM catalog)""",
    "f2_key_difference": f"WITH {cte('catalog')}, {LINES_CTE} SELECT slug FROM lines EXCEPT SELECT slug FROM catalog",
    "b10_splits": f"WITH {cte('predictions')} SELECT query_id, split FROM predictions WHERE split IN ('dev', 'val')",
    "b12_violations": """WITH r AS (SELECT *, CASE WHEN l_linenumber <> 4 THEN concat(l_returnflag, CAST(l_partkey AS VARCHAR)) END AS slug, l_discount * 15 AS confidence FROM lineitem)
      SELECT l_orderkey, l_linenumber, l_partkey, concat_ws(',', CASE WHEN NOT coalesce(length(slug) BETWEEN 1 AND 300, false) THEN 'slug_length' END, CASE WHEN NOT (confidence BETWEEN 0 AND 1) THEN 'confidence_range' END,
      CASE WHEN NOT l_linenumber <= 6 THEN 'few_lines' END, CASE WHEN NOT coalesce(substr(slug, 1, 1) IN ('A', 'N'), false) THEN 'known_flag' END) AS violations FROM r""",
    "h21_sessions": "SELECT event_id, regexp_matches(CASE WHEN user_id % 3 = 0 THEN upper(md5(CAST(user_id AS VARCHAR))) ELSE md5(CAST(user_id AS VARCHAR)) END, '^[a-f0-9]{32}$') AS valid FROM events",
    "d1_facets": f"WITH {cte('catalog')} SELECT count(*) AS total, array_to_string(list_sort(list(DISTINCT category) FILTER (category <> '')), ',') AS categories, count(DISTINCT nullif(winery, '')) AS n_wineries FROM catalog",
    "e1_featured": f"""WITH {cte("catalog")}, p AS (SELECT * FROM (VALUES {', '.join(f"({k}, '{q}')" for k, q in enumerate(C.PRESETS))}) AS v(place, q)),
      f AS (SELECT place, arg_min(slug, pos) AS slug FROM p JOIN catalog c ON len(list_filter(string_split(q, ' '), lambda w: NOT contains({SEARCH_SQL}, w))) = 0 GROUP BY place),
      u AS (SELECT CAST(min(place) AS INT) AS place, slug FROM f GROUP BY slug)
      SELECT * FROM u UNION ALL SELECT * FROM (SELECT CAST(row_number() OVER (ORDER BY pos) - 1 AS INT) AS place, slug FROM catalog ORDER BY pos LIMIT 6) WHERE NOT EXISTS (SELECT 1 FROM u)""",
    "i1_pairing": f"WITH {cte('catalog', 'requests')}, {RULES_CTE} SELECT * FROM recommended",
    "f4_answers_or_rules": f"""WITH {cte('catalog', 'requests')}, {RULES_CTE} SELECT request_id, 1 AS place, 'p-1' AS slug, 'llm' AS method FROM requests WHERE request_id % 3 = 0
      UNION ALL SELECT request_id, place, slug, method FROM recommended WHERE request_id % 3 <> 0""",
    "f4_model_pairings": f"""WITH {cte('catalog', 'requests')}, {RULES_CTE},
      a AS (SELECT request_id, 'Берите [' || CAST(request_id % 4 AS VARCHAR) || '] и [2].' AS answer, CASE WHEN request_id % 4 = 2 THEN [2] ELSE [request_id % 4, 2] END AS said FROM requests WHERE request_id % 3 = 0),
      z AS (SELECT request_id, count(slug) AS n FROM recommended GROUP BY request_id),
      i AS (SELECT a.*, list_filter(said, lambda x: x >= 1 AND x <= z.n) AS inside FROM a JOIN z USING (request_id)),
      u AS (SELECT request_id, unnest(CASE WHEN len(inside) > 0 THEN inside ELSE [1] END) AS position, generate_subscripts(CASE WHEN len(inside) > 0 THEN inside ELSE [1] END, 1) AS place FROM i),
      c AS (SELECT u.request_id, u.place, r.slug FROM u JOIN recommended r ON r.request_id = u.request_id AND r.place = u.position AND r.slug IS NOT NULL)
      SELECT a.request_id, CAST(c.place AS INT) AS place, c.slug, p.title, a.answer AS explanation, p.temperature, 'model' AS method FROM a JOIN plan p ON p.request_id = a.request_id LEFT JOIN c ON c.request_id = a.request_id
      UNION ALL SELECT request_id, place, slug, title, explanation, temperature, method FROM recommended WHERE request_id % 3 <> 0""",
    "h11_pairing_question": f"""WITH {cte("requests")}, prefs AS (SELECT * FROM {_values(P.PREFERENCES, 'preference, wanted, adjective, wanted_text')}), dishes AS (SELECT * FROM {_values(P.DISH_WORDS, 'dish, words')})
      SELECT r.request_id, 'Подбери ' || coalesce(p.adjective || ' ', '') || 'вино к ' || d.words || '.' AS question FROM requests r JOIN dishes d ON r.dish = d.dish LEFT JOIN prefs p ON r.preference = p.preference""",
    "h6_card_text": f"WITH {cte('catalog')} SELECT slug, {CARD_SQL} AS text FROM catalog",
    "h7_shortlist_line": f"WITH {cte('catalog')} SELECT slug, {LINE_SQL.format(position='(pos % 6 + 1)')} AS line FROM catalog",
    "h1_normalize": f"SELECT conv_id * 1000 + turn AS id, {_spell('text')} AS text FROM conversations",
    "h2_ngrams": f"WITH {GRAMS_CTE} SELECT id, gram, count(*) AS n FROM grams GROUP BY id, gram",
    "h3_ngram_vectors": f"""WITH {GRAMS_CTE}, h AS (SELECT id, md5(gram) AS m FROM grams),
      e AS (SELECT id, CAST(CAST('0x' || substr(m, 1, 15) AS BIGINT) % 512 AS INT) AS bucket, CASE WHEN CAST('0x' || substr(m, 16, 1) AS BIGINT) % 2 = 1 THEN 1.0 ELSE -1.0 END AS sign FROM h),
      s AS (SELECT id, bucket, CAST(sum(sign) AS DOUBLE) AS s FROM e GROUP BY id, bucket HAVING sum(sign) <> 0)
      SELECT id AS item_id, bucket, round(s / sqrt(sum(s * s) OVER (PARTITION BY id)), 6) AS value FROM s""",
}
_FOLD = "CAST(count(*) AS BIGINT) AS n, sha256(string_agg({0}, chr(10) ORDER BY {1})) AS digest"
_TREE = f"""WITH {cte("catalog")}, rows AS (SELECT md5(slug) AS place, concat(slug, ':', sha256(concat(name, '. ', winery)), ':1') AS row FROM catalog),
l3 AS (SELECT substr(place, 1, 3) AS node, {_FOLD.format("row", "row")} FROM rows GROUP BY 1),
l2 AS (SELECT substr(node, 1, 2) AS node, {_FOLD.format("concat(node, ':', digest)", "node")} FROM l3 GROUP BY 1),
l1 AS (SELECT substr(node, 1, 1) AS node, {_FOLD.format("concat(node, ':', digest)", "node")} FROM l2 GROUP BY 1),
l0 AS (SELECT '' AS node, {_FOLD.format("concat(node, ':', digest)", "node")} FROM l1)
SELECT 3 AS level, * FROM l3 UNION ALL SELECT 2, * FROM l2 UNION ALL SELECT 1, * FROM l1 UNION ALL SELECT 0, * FROM l0"""
ORACLES |= {
    "a10_signature_tree": _TREE,
    "a10_updated_tree": _TREE,
    "a9_versions": """WITH d AS (SELECT doc_id, concat('doc/', CAST(doc_id AS VARCHAR)) AS slug, doc_id % 11 <> 0 AS a, doc_id % 7 <> 0 AS b, doc_id % 5 = 0 AS other FROM documents)
      SELECT 1 AS step, slug, 'recompute' AS action, 'new' AS reason FROM d WHERE a
      UNION ALL SELECT 2, slug, CASE WHEN b THEN 'recompute' ELSE 'drop' END, CASE WHEN NOT b THEN 'gone' WHEN a THEN 'changed' ELSE 'new' END FROM d WHERE a <> b OR (a AND b AND other)
      UNION ALL SELECT 4, slug, 'recompute', 'size' FROM d WHERE b""",
}
ORACLES |= {
    "h1_spelled": _spelled_sql(),
    "b2_indexed_search": ORACLES["b2_token_search"],
    "b3_indexed_page": f"""{FOUND_SQL}, everything AS (SELECT concat('all/', k.category) AS query_id, c.slug, c.pos FROM (SELECT DISTINCT category FROM catalog) k JOIN catalog c ON k.category = '' OR c.category = k.category),
      both_found AS (SELECT query_id, slug, pos FROM found UNION ALL SELECT * FROM everything),
      p AS (SELECT query_id, slug, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS n FROM both_found) SELECT query_id, slug, n - 1 AS n FROM p WHERE n > 1 AND n <= 4""",
}
