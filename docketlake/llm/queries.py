"""The registered queries of this subpackage, each over its whole table."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docketlake.llm import (
    bpe, kneser_ney, langid, licenses, packing, pii, prefix_trie, quality, simhash, spelling, token_rollup, topk, vector_graph,
)
from docketlake.llm.text import fold
from docketlake.session import DEFAULTS, find_package, materialize, shared_folder


#: Rows that a Python worker gets at a time; documents are some kilobytes, and some far more.
ARROW_ROWS = 1000


def tokenizer_file(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    find_package(spark)
    for setting in ("spark.sql.session.timeZone", "spark.sql.ansi.enabled"):
        if spark.conf.get(setting) != DEFAULTS[setting]:
            spark.conf.set(setting, DEFAULTS[setting])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ARROW_ROWS)
    return spark.read.parquet(f"{sf}/{name}.parquet")


def op1_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.filter(fold("doc_id", 3) != 1))
    found = langid.predict(model, "text", spark)
    return docs.select("doc_id", (fold("doc_id", 3) == 1).alias("held_out"), found.alias("p")).select(
        "doc_id", "held_out", "p.*")


def op2_bpe_round_trip(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return bpe.round_trip(docs, tokenizer_file()).select("doc_id", "_trip.*")


def op3_simhash_groups(spark: SparkSession, sf: str) -> DataFrame:
    found = simhash.groups(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op4_quality_grades(spark: SparkSession, sf: str) -> DataFrame:
    """Every document's expected grade and tail probabilities, and whether it would be selected."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.grades(table(spark, sf, "labels")))
    rated = docs.select("doc_id", quality.predict(model, "text", spark).alias("p")).select("doc_id", "p.*")
    return rated.select(
        "doc_id", "expected_grade", F.element_at("tails", 1).alias("p_grade_1"),
        F.element_at("tails", -1).alias("p_grade_2"), quality.selected(F.col("tails")).alias("keep"))


def op5_kneser_ney(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = kneser_ney.fit(docs.filter(fold("doc_id", 5) != 1))
    return docs.select("doc_id", (fold("doc_id", 5) == 1).alias("held_out"),
                       F.lit(model.total).cast("long").alias("train_tokens"),
                       kneser_ney.score(model, "text").alias("p")).select(
        "doc_id", "held_out", "train_tokens", "p.*")


def op6_vector_graph(spark: SparkSession, sf: str) -> DataFrame:
    return vector_graph.near_duplicates(table(spark, sf, "embeddings").select("vec_id", "embedding"))


def op7_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    found = licenses.scan(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", F.array_join("_scan.sentences", ",").alias("sentences"),
                        F.array_join("_scan.licences", ",").alias("licences"))


def op8_token_rollup(spark: SparkSession, sf: str) -> DataFrame:
    """Totals after four batches: documents under two tokenizers, texts without repeated
    lines for those that have such, and toxic documents withdrawn; two batches arrive twice."""
    docs = table(spark, sf, "documents").select("doc_id", "source", "lang", "text")
    lines = F.array_join(F.array_distinct(F.split("text", "\n")), "\n")
    docs = docs.withColumn("new", F.when(lines != F.col("text"), lines))
    file = tokenizer_file()
    counted = docs.select(
        "doc_id", "source", "lang", F.col("new").isNotNull().alias("changed"),
        token_rollup.words("text").alias("words"), F.octet_length("text").alias("bytes"),
        token_rollup.words("new").alias("new_words"), F.octet_length("new").alias("new_bytes"),
        bpe.count(file, "text").alias("ids"), bpe.count(file, "new").alias("new_ids"))
    counted = materialize(counted, "counted")
    versions = (("words", "words", "new_words"), ("word_bpe_49k", "ids", "new_ids"))

    def changes(rows: DataFrame, op: str, before: bool, after: bool) -> DataFrame:
        """Each document's change once per tokenizer version."""
        none = F.lit(None)
        per = [F.struct(
            (now if before else none).alias("before"), (new if after else none).alias("after"))
            for version, n, m in versions
            for now, new in [(token_rollup.side(version, F.col(n), F.col("bytes")),
                              token_rollup.side(version, F.col(m), F.col("new_bytes")))]]
        return rows.select(F.lit(op).alias("op"), F.inline(F.array(*per)))

    first = counted.withColumns({"new_words": F.col("words"), "new_ids": F.col("ids"), "new_bytes": F.col("bytes")})
    current = counted.withColumns({
        n: F.when(F.col("changed"), F.col(f"new_{n}")).otherwise(F.col(n)) for n in ("words", "ids", "bytes")})
    toxic = table(spark, sf, "labels").filter("toxic = 1").select("doc_id").distinct()
    revised = changes(counted.filter("changed"), "revise", True, True)
    withdrawn = changes(current.join(toxic, "doc_id", "left_semi"), "delete", True, False)
    rollup = token_rollup.Rollup(spark, f"{shared_folder(spark)}/token-rollup-{uuid.uuid4().hex}")
    rollup.commit("load", changes(first, "insert", False, True))
    for name, batch in (("lines", revised), ("toxic", withdrawn), ("lines", revised), ("toxic", withdrawn)):
        rollup.commit(name, batch)
    return rollup.totals()


def op9_best_fit_packing(spark: SparkSession, sf: str) -> DataFrame:
    return packing.packed(table(spark, sf, "documents").select("doc_id", "text"), tokenizer_file())


def op10_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "embeddings").select("vec_id", "embedding")
    return topk.top_k(rows, F.col("vec_id") % 50 == 0)


def op11_pii(spark: SparkSession, sf: str) -> DataFrame:
    """Counts and digest of the base spans, and all spans, of every document."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return pii.digests(docs, name="_pii").select("doc_id", "_pii.*")


def op12_prefix_trie(spark: SparkSession, sf: str) -> DataFrame:
    """The trie of all conversations, each rebuilt on the beginning of its group's first."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    return prefix_trie.trie(prefix_trie.rebuilt(turns))


def op13_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """The forms of all words of the documents, one run in 31 without one of its letters."""
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return spelling.variants(spelling.occurrences(docs, every=31))


QUERIES = {f.__name__: f for f in (
    op1_language_id, op2_bpe_round_trip, op3_simhash_groups, op4_quality_grades, op5_kneser_ney,
    op6_vector_graph, op7_license_scan, op8_token_rollup, op9_best_fit_packing, op10_exact_top_k,
    op11_pii, op12_prefix_trie, op13_spelling_variants,
)}


def _license_sql() -> str:
    """The same table of sentences and the same rules, for DuckDB."""
    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def ids(ends: str) -> str:
        """The known sentences of one way of reading, as structs (at, id)."""
        split = f"string_split(regexp_replace(coalesce(text, ''), {quoted(ends)}, chr(1) || '\\0' || chr(1), 'g'), chr(1))"
        size = "length(regexp_replace(lower(s), '[^a-z0-9]+', '', 'g'))"
        later = "regexp_replace(lower(s), '([0-9])[+]', '\\1 or later ', 'g')"
        plain = f"trim(regexp_replace({later}, '[^a-z0-9]+', ' ', 'g'))"
        begins, goes_on, no = map(quoted, (licenses.BEGINS, licenses.GOES_ON, licenses.NO_NOTICE))
        clean = (f"CASE WHEN regexp_matches({plain}, {begins}) AND NOT regexp_matches({plain}, {no}) THEN "
                 f"regexp_replace(regexp_replace({plain}, {begins}, 'notice '), {goes_on}, '') ELSE {plain} END")
        near = f"length(s) BETWEEN {licenses.SHORTEST} AND {licenses.SPARE}"
        sizes = f"list_transform({split}, lambda s: {size})"
        found = f"list_transform({split}, lambda s: CASE WHEN {near} THEN known[{clean}] END)"
        pairs = (f"list_transform({found}, lambda x, n: {{'at': list_sum(list_slice({sizes}, 1, n))::BIGINT, 'id': x}})")
        return f"list_filter({pairs}, lambda p: p.id IS NOT NULL)"

    pairs = ", ".join(f"{quoted(k)}: {quoted(v)}" for k, v in licenses.KNOWN.items())
    steps = []
    for k, (run, licence) in enumerate(licenses.RULES, 1):
        mark = quoted("|" + "||".join(run) + "|")
        steps.append(f"s{k} AS (SELECT * EXCLUDE (rest, hits), replace(rest, {mark}, '|') AS rest, "
                     f"CASE WHEN contains(rest, {mark}) THEN list_append(hits, {quoted(licence)}) ELSE hits END AS hits "
                     f"FROM s{k - 1})")
    return f"""
        WITH k AS (SELECT MAP {{{pairs}}} AS known), i AS (
            SELECT doc_id, {ids(licenses.LINE_ENDS)} AS a, {ids(licenses.SENTENCE_ENDS)} AS b FROM documents, k
            WHERE regexp_matches(text, {quoted(licenses.TELLING)})
            UNION ALL SELECT doc_id, [], [] FROM documents WHERE NOT coalesce(regexp_matches(text, {quoted(licenses.TELLING)}), false)
        ), j AS (
            SELECT doc_id, list_transform(list_sort(list_distinct(list_concat(a, b))), lambda p: p.id) AS sentences FROM i
        ), s0 AS (
            SELECT doc_id, sentences, '|' || array_to_string(sentences, '||') || '|' AS rest, []::VARCHAR[] AS hits FROM j
        ), {", ".join(steps)}, u AS (
            SELECT doc_id, sentences, list_filter(hits, lambda x, n: list_position(hits, x) = n) AS hits
            FROM s{len(licenses.RULES)}
        )
        SELECT doc_id, array_to_string(sentences, ',') AS sentences, array_to_string(hits, ',') AS licences FROM u
    """


def _crc32_sql(text: str) -> str:
    """The unsigned crc32 of a text's UTF-8 bytes: each byte is mixed in, then eight bits are shifted out."""
    octets = f"list_transform(range(octet_length(encode({text}))), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    steps = f"flatten(list_transform({octets}, lambda b: [b, -1, -1, -1, -1, -1, -1, -1, -1]))"
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {steps}), lambda acc, x: CASE WHEN x >= 0 "
            "THEN xor(acc, x) ELSE xor(acc >> 1, 3988292384 * (acc & 1)) END), 4294967295)")


ORACLE_SQL: dict[str, str] = {
    "op12_prefix_trie": f"""
        WITH t AS (
            SELECT conv_id AS c, coalesce(role, '') AS role, coalesce(text, '') AS text,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS k
            FROM conversations WHERE conv_id IS NOT NULL
        ), ids AS (
            SELECT c, {_crc32_sql("c::VARCHAR")} % 4 AS h FROM (SELECT DISTINCT c FROM t)
        ), r AS (
            SELECT i.c, t.role, t.text, 0 AS part, t.k FROM ids i JOIN t ON t.c = i.c - i.c % 20 AND t.k <= i.h
            UNION ALL SELECT i.c, t.role, t.text, 1, t.k FROM ids i JOIN t ON t.c = i.c AND t.k > i.h
        ), turns AS (
            SELECT c, md5(role || chr(0) || text) AS m, row_number() OVER (PARTITION BY c ORDER BY part, k) AS d,
                   len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')) AS w
            FROM r
        ), prefixes AS (
            SELECT c, d, w, md5(string_agg(m, '') OVER (PARTITION BY c ORDER BY d)) AS key FROM turns
            UNION ALL SELECT c, 0, 0, '' FROM ids
        ), linked AS (
            SELECT p.*, u.key AS up, d = max(d) OVER (PARTITION BY p.c) AS is_end
            FROM prefixes p LEFT JOIN (SELECT c, d + 1 AS d, key FROM prefixes) u USING (c, d)
        ), nodes AS (
            SELECT key, d AS depth, any_value(up) AS up, min(c) AS conv_id, count(*) AS n_convs, any_value(w) AS w,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (is_end), '')) AS ends_sha256
            FROM linked GROUP BY key, d
        ), counted AS (
            SELECT n.*, coalesce(k.n_children, 0) AS n_children
            FROM nodes n LEFT JOIN (
                SELECT up, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY up, depth
            ) k ON k.up = n.key AND k.depth = n.depth
        ), below AS (
            SELECT p.key, p.d AS depth, count(*) FILTER (n.n_children = 0) AS n_leaves, sum((n.n_convs - 1) * n.w) AS saved
            FROM counted n JOIN prefixes p ON p.c = n.conv_id AND p.d <= n.depth GROUP BY p.key, p.d
        )
        SELECT n.conv_id, n.depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children,
               b.n_leaves, b.saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM counted n JOIN below b ON b.key = n.key AND b.depth = n.depth
        LEFT JOIN nodes u ON u.key = n.up AND u.depth = n.depth - 1
    """,
    "op13_spelling_variants": f"""
        WITH RECURSIVE runs AS (
            SELECT doc_id, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run
            FROM documents
        ), counted AS (
            SELECT doc_id, run, count(*) AS m, {_crc32_sql("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h
            FROM runs WHERE length(run) >= 7 GROUP BY doc_id, run
        ), spelled AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2)
                   ELSE run END AS word, m
            FROM counted
        ), words AS (
            SELECT word, sum(m)::BIGINT AS n FROM spelled WHERE length(word) >= 7 GROUP BY word HAVING sum(m) >= 2
        ), cut AS (
            SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)
        ), pairs AS (
            SELECT a.word, b.word AS near, b.n AS m FROM cut a JOIN cut b
            ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT c.word, w.word, w.n FROM cut c JOIN words w ON c.rest = w.word
            UNION SELECT w.word, c.word, c.n FROM cut c JOIN words w ON c.rest = w.word
        ), best AS (
            SELECT word, count(*) AS n_near, arg_min(near, (-m, encode(near))) AS near, max(m) AS m
            FROM pairs GROUP BY word
        ), forms AS (
            SELECT w.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN m >= 10 * n THEN near END AS form,
                   CASE WHEN m >= 10 * n THEN m END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word
        ), follow AS (
            SELECT word, word AS root, form AS next FROM forms
            UNION ALL
            SELECT f.word, f.next, g.form FROM follow f JOIN forms g ON g.word = f.next
        )
        SELECT f.word, form, r.root, n, n_near, form_n
        FROM forms f JOIN follow r ON r.word = f.word AND r.next IS NULL
    """,
    "op7_license_scan": _license_sql(),
    "op6_vector_graph": """
        WITH RECURSIVE v AS (
            SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
            WHERE len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
              AND len(list_filter(embedding, lambda x: x <> 0)) > 0
        ), l AS (
            SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id
            AND list_cosine_similarity(a.e, b.e) >= 0.95
        ), r(a, b) AS (
            SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM r JOIN l ON l.a = r.b
        ), c AS (SELECT a, min(b) AS component_id FROM r GROUP BY a),
        n AS (SELECT a, count(*) AS n_links FROM l GROUP BY a)
        SELECT vec_id, coalesce(n_links, 0)::BIGINT AS n_links, component_id, vec_id = component_id AS kept
        FROM embeddings JOIN c ON c.a = vec_id LEFT JOIN n ON n.a = vec_id
    """,
    "op10_exact_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
            FROM embeddings
            WHERE len(embedding) = len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x)))
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        )
        SELECT query_id, (row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id))::INT AS rank,
               vec_id, score
        FROM s QUALIFY rank <= 5
    """,
}
