"""opN_<name>: each operator over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_codec
from .ann import search
from .importance import resample
from .merkle import verify
from .mixing import copies
from .ngram_join import similar
from .pii import KINDS, scan
from .quality_lm import classify
from .quality_rules import with_quality
from .registry import query
from .sentencepiece_codec import encode
from .shared import table
from .substring_dedup import remove_repeats
from .toxicity import THRESHOLD, held_out, score
from .url_filters import judge


@query("op3_quality_rules")
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored, q = with_quality(docs)
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
    return scored.select("doc_id", *[F.col(q)[k].alias(k) for k in names])


_OP5 = r"""
WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
wins AS (SELECT doc_id, i, array_to_string(ws[i : i + 12], ' ') AS k FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 11)) AS i FROM texts WHERE len(ws) >= 13)),
least AS (SELECT k, min(doc_id) AS m FROM wins GROUP BY k),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM wins JOIN least USING (k), range(0, 13) r(j) WHERE m < doc_id),
lost AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(ps), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN ps IS NULL THEN ws ELSE list_filter(ws, lambda w, i: NOT list_contains(ps, i)) END, ' '), '')) AS kept_sha256
FROM texts LEFT JOIN lost USING (doc_id)
"""


@query("op5_substring_dedup", _OP5)
def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


_OP8 = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         (CAST('0x' || substr(md5('17:' || coalesce(doc_id::VARCHAR, '')), 1, 13) AS BIGINT)::DOUBLE + 0.5) / 4503599627370496.0 AS u
  FROM documents),
totals AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight,
         (2 * source_size)::DOUBLE AS cap, 1.5::DOUBLE * sum(source_size) OVER () AS total FROM totals),
filled AS (
  SELECT *, cap / weight <= (total - coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS filled FROM weighed),
targets AS (
  SELECT source, source_size, CASE WHEN filled THEN cap ELSE weight * ((total - coalesce(sum(CASE WHEN filled THEN cap END) OVER (), 0))
         / sum(CASE WHEN NOT filled THEN weight END) OVER ()) END AS target FROM filled),
parts AS (
  SELECT *, floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) AS certain,
         target - floor(CASE WHEN source_size > 0 THEN target / source_size ELSE 0 END) * source_size AS left_words FROM targets),
roots AS (SELECT source, ceil(sqrt(size::DOUBLE))::BIGINT AS root, sum(size)::BIGINT AS words FROM sized WHERE size > 0 GROUP BY ALL),
shares AS (
  SELECT r.*, left_words, coalesce(sum(words) OVER (PARTITION BY r.source ORDER BY root DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before,
         sum(words * root) OVER (PARTITION BY r.source ORDER BY root DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS rest
  FROM roots r JOIN parts t ON r.source IS NOT DISTINCT FROM t.source),
rates AS (
  SELECT source, (left_words - coalesce(sum(CASE WHEN rest <= root * (left_words - before) THEN words END), 0)::DOUBLE)
         / nullif(sum(CASE WHEN rest <= root * (left_words - before) THEN 0 ELSE words * root END)::DOUBLE, 0) AS rate FROM shares GROUP BY source, left_words),
chances AS (
  SELECT s.*, t.source_size, t.target, t.certain, t.left_words,
         CASE WHEN size > 0 AND left_words > 0 THEN greatest(0.0::DOUBLE, least(1.0::DOUBLE, coalesce(rate, 1.0::DOUBLE) * ceil(sqrt(size::DOUBLE)))) ELSE 0.0::DOUBLE END AS p
  FROM sized s JOIN parts t ON s.source IS NOT DISTINCT FROM t.source LEFT JOIN rates r ON s.source IS NOT DISTINCT FROM r.source),
ranked AS (SELECT *, (u * (1 - p)) / (u * (1 - p) + p * (1 - u)) AS pareto FROM chances),
summed AS (SELECT *, sum(CASE WHEN left_words > 0 THEN size ELSE 0 END) OVER (PARTITION BY source ORDER BY pareto, doc_id ROWS UNBOUNDED PRECEDING) AS after_it FROM ranked),
picked AS (
  SELECT *, after_it <= left_words AND size > 0 AND left_words > 0 AS prefix,
         left_words - max(CASE WHEN after_it <= left_words THEN after_it ELSE 0 END) OVER (PARTITION BY source) AS gap FROM summed),
closing AS (
  SELECT source, doc_id FROM picked WHERE NOT prefix AND size > 0 AND left_words > 0 AND abs(size - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(size - gap), pareto, doc_id) = 1)
SELECT p.doc_id, p.size, p.source_size, p.target,
       (CASE WHEN p.size > 0 THEN (certain + CASE WHEN prefix OR c.doc_id IS NOT NULL THEN 1 ELSE 0 END) * p.size ELSE 0 END)::BIGINT AS taken
FROM picked p LEFT JOIN closing c ON p.source IS NOT DISTINCT FROM c.source AND p.doc_id = c.doc_id
"""


@query("op8_mixing", _OP8)
def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = copies(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "size", "source_size", "target", (F.col("n_copies") * F.col("size")).cast("long").alias("taken"))


_OP9 = r"""
WITH located AS (
  SELECT page_id, CASE WHEN position('://' IN url) > 0 THEN substr(url, position('://' IN url) + 3) ELSE '' END AS rest FROM pages),
parts AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM located),
rules(rule, action) AS (VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')),
hits AS (
  SELECT p.page_id, p.host, p.path, arg_max(r.rule, length(r.rule)) AS rule, arg_max(r.action, length(r.rule)) AS action
  FROM (SELECT DISTINCT * FROM parts) p JOIN rules r
    ON ('.' || p.host) LIKE ('%.' || split_part(r.rule, '/', 1)) AND starts_with(p.path, substr(r.rule, position('/' IN r.rule)))
  GROUP BY ALL)
SELECT p.page_id, p.host, p.path, h.rule,
       CASE WHEN h.rule IS NOT NULL THEN h.action
            WHEN regexp_matches(p.host, '(^|[^a-z0-9])(spam|casino|pills|bets|adult|ads|porn|xxx|warez|phish)([^a-z0-9]|$)') THEN 'block'
            WHEN regexp_matches(p.host, '(^|[^a-z0-9])(click[._-]track|win[._-]prize|cheap[._-]meds|payday[._-]loans|fake[._-]login)([^a-z0-9]|$)') THEN 'block'
            WHEN regexp_matches(translate(p.path, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
              '[^a-z0-9](online[^a-z0-9]+casino|buy[^a-z0-9]+pills|free[^a-z0-9]+porn|sports[^a-z0-9]+bets|crack[^a-z0-9]+serial|work[^a-z0-9]+from[^a-z0-9]+home[^a-z0-9]+cash)([^a-z0-9]|$)') THEN 'block'
            ELSE 'allow' END AS verdict
FROM parts p LEFT JOIN hits h ON p.page_id = h.page_id AND p.host = h.host AND p.path = h.path
"""


@query("op9_url_filters", _OP9)
def op9_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = judge(table(spark, sf_dir, "pages").select("page_id", "url"))
    return found.select("page_id", "host", "path", "rule", "verdict")


@query("op10_pii")
def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = scan(table(spark, sf_dir, "documents").select("doc_id", "text"), clean=False)
    spans = F.col(name)["spans"]
    base = F.filter(spans, lambda x: x["kind"] != "term")

    def count(kind: str):
        return F.size(F.filter(spans, lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    joined = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    return found.select("doc_id", *map(count, KINDS[:4]), F.sha2(joined(base), 256).alias("base_sha256"), joined(spans).alias("spans"), count("term"))


@query("op2_sentencepiece")
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, name = encode(table(spark, sf_dir, "documents").select("doc_id", "text"))
    ids = F.col(name)["ids"]
    return found.select("doc_id", F.coalesce(F.size(ids), F.lit(0)).cast("long").alias("n_tokens"), ids.alias("ids"), F.col(name)["round_trip"].alias("round_trip"))


@query("op4_ann")
def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op7_toxicity")
def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labelled = table(spark, sf_dir, "labels").where(~held_out(F.col("doc_id"))).select("doc_id", "toxic")
    found = score(table(spark, sf_dir, "documents"), labelled)
    out = F.coalesce(held_out(F.col("doc_id")), F.lit(False))
    return found.select("doc_id", out.alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "evidence")


_OP6 = r"""
WITH RECURSIVE texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
grams AS (
  SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM texts WHERE len(ws) > 0)),
sets AS (SELECT doc_id, count(*) AS n, md5(string_agg(g, chr(10) ORDER BY g)) AS h FROM grams GROUP BY doc_id),
copies AS (SELECT h, min(doc_id) AS copy_of FROM sets GROUP BY h),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM grams a JOIN grams b USING (g) WHERE a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM shared JOIN sets s ON s.doc_id = x JOIN sets t ON t.doc_id = y WHERE c >= 0.8 * (s.n + t.n - c) - 1e-9),
reach(x, y) AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON r.y = l.x),
classes AS (SELECT x, min(y) AS m FROM reach GROUP BY x),
degrees AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT d.doc_id, least(d.doc_id, coalesce(m, d.doc_id)) AS class_id, coalesce(copy_of, d.doc_id) AS copy_of, coalesce(g.n, 0)::BIGINT AS n_links
FROM documents d LEFT JOIN sets s USING (doc_id) LEFT JOIN copies USING (h) LEFT JOIN classes c ON c.x = d.doc_id LEFT JOIN degrees g ON g.x = d.doc_id
"""


@query("op6_ngram_join", _OP6)
def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = similar(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "class_id", "copy_of", "n_links")


@query("op1_quality_classifier")
def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    trusted = table(spark, sf_dir, "labels").where("quality = 1").select("doc_id")
    found = classify(table(spark, sf_dir, "documents"), trusted)
    return found.select("doc_id", "lang", "n_words", "perplexity", "threshold", "kept")


@query("op11_bpe")
def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both, ids = bpe_codec.encode(docs, packed=True, back="decoded")
    n_tokens = (F.octet_length(ids) / 4).cast("long").alias("n_tokens")
    return both.select("doc_id", n_tokens, F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def _crc32_sql(s: str) -> str:
    """CRC-32 of a string's UTF-8 bytes; the query has the table crc(t) of all bytes' registers."""
    octets = f"list_transform(regexp_extract_all(hex(encode({s})), '..'), lambda x: ('0x' || x)::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {octets}), lambda c, b: xor(crc.t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295)"


_CRC = "crc AS (SELECT list_transform(range(0, 256), lambda b: list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS t)"


def _merkle_sql(levels: int = 7, tops: int = 4) -> str:
    """Trees of up to 16^levels leaves over up to 16^tops sources, level by level."""

    def digest(text: str) -> str:
        part = lambda c: f"coalesce(octet_length(encode({c}::VARCHAR)) || ':' || {c}::VARCHAR, '-')"
        return "sha256(" + " || ".join(map(part, ("doc_id", "source", "lang", "n_chars", text))) + ")"

    def climb(name: str, steps: int) -> list[str]:
        out = []
        for k in range(steps):
            runs = f"SELECT t, i // 16 AS p, n, list(h ORDER BY i) AS hs FROM {name}{k} WHERE n > 1 GROUP BY t, i // 16, n"
            out.append(f"{name}_runs{k} AS ({runs})")
            out.append(f"{name}{k + 1} AS (SELECT t, p AS i, (n + 15) // 16 AS n, sha256(array_to_string(hs, '')) AS h FROM {name}_runs{k} UNION ALL SELECT t, i, n, h FROM {name}{k} WHERE n = 1)")
        return out

    def fold(name: str, at: str, tree: str, steps: int, before: str, prefix: str) -> list[str]:
        out = []
        for k in range(steps):
            own = f"({at} // {16**k}) % 16 + 1"
            others = "coalesce(array_to_string(list_filter(hs, lambda x, j: j <> " + own + "), ''), '')"
            with_own = "sha256(array_to_string(list_transform(hs, lambda x, j: CASE WHEN j = " + own + " THEN folded ELSE x END), ''))"
            columns = f"f.* EXCLUDE (folded, proof), proof || {others} AS proof, CASE WHEN hs IS NULL THEN folded ELSE {with_own} END AS folded"
            out.append(f"{prefix}{k} AS (SELECT {columns} FROM {before if k == 0 else f'{prefix}{k - 1}'} f LEFT JOIN {name}_runs{k} r ON r.t = {tree} AND r.p = {at} // {16 ** (k + 1)})")
        return out

    tampered = f"CASE WHEN {_crc32_sql('doc_id::VARCHAR')} % 5 = 0 THEN translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE text END"
    parts = [
        _CRC,
        f"hashed AS (SELECT doc_id, source, {digest('text')} AS leaf, {digest('changed')} AS claimed FROM (SELECT *, {tampered} AS changed FROM documents, crc))",
        "placed AS (SELECT *, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf, claimed) - 1 AS spot, count(*) OVER (PARTITION BY source) AS size FROM hashed)",
        "a0 AS (SELECT tree AS t, spot AS i, size AS n, leaf AS h FROM placed)",
        *climb("a", levels),
        f"b0 AS (SELECT 0 AS t, t AS i, count(*) OVER () AS n, h FROM a{levels})",
        *climb("b", tops),
        "start AS (SELECT *, claimed AS folded, '' AS proof FROM placed)",
        *fold("a", "spot", "tree", levels, "start", "up"),
        *fold("b", "tree", "0", tops, f"up{levels - 1}", "over"),
    ]
    body = f"SELECT doc_id, leaf, a{levels}.h AS subroot, b{tops}.h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = b{tops}.h AS verified FROM over{tops - 1} o JOIN a{levels} ON a{levels}.t = o.tree CROSS JOIN b{tops}"
    return "WITH " + ",\n".join(parts) + "\n" + body


@query("op12_merkle", _merkle_sql())
def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    tampered = F.when(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, lower).otherwise(F.col("text"))
    return verify(docs, {"text": tampered}).drop("source")


_OP13 = rf"""
WITH {_CRC},
told AS (
  SELECT row_number() OVER () AS r, doc_id, s, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws
  FROM (SELECT doc_id, text, true AS s FROM documents UNION ALL SELECT NULL, text, false FROM benchmark)),
grams AS (
  SELECT r, s, array_to_string(ws[i : i + k - 1], ' ') AS g FROM (SELECT r, s, ws, unnest(range(1, len(ws) + 1)) AS i FROM told WHERE len(ws) > 0), range(1, 4) k(k) WHERE i + k - 1 <= len(ws)),
spelt AS (SELECT g, {_crc32_sql("g")} % 10000 AS b FROM (SELECT DISTINCT g FROM grams), crc),
found AS (SELECT r, s, b, count(*) AS c FROM grams JOIN spelt USING (g) GROUP BY ALL),
sides AS (SELECT b, coalesce(sum(c) FILTER (s), 0) AS s, coalesce(sum(c) FILTER (NOT s), 0) AS t FROM found GROUP BY b),
gains AS (SELECT b, floor(1000 * ln((t + 1)::DOUBLE * (sum(s) OVER () + 10000)::DOUBLE / ((s + 1)::DOUBLE * (sum(t) OVER () + 10000)::DOUBLE)))::BIGINT AS gain FROM sides),
weights AS (SELECT r, sum(c)::BIGINT AS n_features, sum(c * gain)::BIGINT AS weight FROM found JOIN gains USING (b) WHERE s GROUP BY r),
scored AS (
  SELECT r, doc_id, len(ws) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('42:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296.0::DOUBLE)))::BIGINT AS score
  FROM told LEFT JOIN weights USING (r) WHERE s),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, n_features, weight, n_words) AS k, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, CASE WHEN k <= 5 * n // 100 THEN k END AS rank FROM scored LEFT JOIN ranked USING (r)
"""


@query("op13_importance", _OP13)
def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = resample(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark").select("text"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
