"""The same queries as SQL, where SQL can say them.

XXH64 fingerprints, byte-pair merges, file round trips and trained models are not SQL: those queries are tested by brute force.
"""

from __future__ import annotations

from copresence.llm import secret_scan

_SPACE = r"[\x20\x09-\x0D]"

EMBEDDINGS = """
WITH RECURSIVE sound AS (
    SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), link AS (
    SELECT a.vec_id AS a, b.vec_id AS b FROM sound a JOIN sound b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
    WHERE list_cosine_similarity(a.v, b.v) >= 0.93
), reach(a, b) AS (
    SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a
), low AS (SELECT a, min(b) AS component_id FROM reach GROUP BY a),
degree AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN low ON low.a = vec_id LEFT JOIN degree ON degree.a = vec_id
"""

URLS = """
WITH rule(verdict, host, path) AS (VALUES ('block', 'net', '/'), ('allow', 'example.net', '/en/'), ('block', 'example.com', '/de/'), ('allow', 'org', '/fr/')),
page AS (
    SELECT page_id, translate(coalesce(regexp_extract(url, '://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
        coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
    FROM pages
), fit AS (
    SELECT page_id, max_by(rule.host || rule.path, length(rule.host || rule.path)) AS rule, max_by(rule.verdict, length(rule.host || rule.path)) AS verdict
    FROM page JOIN rule ON (page.host = rule.host OR ends_with(page.host, '.' || rule.host)) AND starts_with(page.path, rule.path) GROUP BY page_id
)
SELECT page.page_id, page.host, page.path, fit.rule, coalesce(fit.verdict, 'allow') AS verdict FROM page LEFT JOIN fit USING (page_id)
"""

EXACT = f"""
WITH doc AS (
    SELECT doc_id, length(coalesce(text, '')) AS n, sha256(regexp_replace(coalesce(text, ''), '{_SPACE}+', '', 'g')) AS text_sha256 FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size, row_number() OVER best = 1 AS kept, text_sha256
FROM doc WINDOW best AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


def _allot(nodes: str, parent: list[str], name: str) -> str:
    """Shares of the children in `nodes` (capacity, weight, budget)."""
    by = ", ".join(parent) or "NULL"
    before = f"OVER (PARTITION BY {by} ORDER BY capacity / weight, {name} NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
    whole = f"OVER (PARTITION BY {by})"
    columns = ", ".join([*parent, name])
    return f"""
    SELECT {columns}, CASE WHEN full_ THEN capacity ELSE (weight * max(left_budget) FILTER (WHERE NOT full_) {whole}) // max(left_weight) FILTER (WHERE NOT full_) {whole} END AS share
    FROM (SELECT *, capacity * left_weight <= weight * left_budget AS full_ FROM (
        SELECT *, budget - coalesce(sum(capacity) {before}, 0) AS left_budget, sum(weight) {whole} - coalesce(sum(weight) {before}, 0) AS left_weight
        FROM {nodes} WHERE weight > 0))"""


MIX = f"""
WITH doc AS (
    SELECT doc_id, lang, source, CASE WHEN source = 'src0' THEN 'hub'
        WHEN CAST(coalesce(nullif(regexp_extract(coalesce(source, ''), '([0-9]{{1,9}})$', 1), ''), '0') AS INT) % 2 = 1 THEN 'odd' ELSE 'even' END AS domain,
        CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS tokens
    FROM documents
), leaf AS (SELECT domain, lang, source, CAST(sum(tokens) AS HUGEINT) AS tokens FROM doc GROUP BY ALL HAVING sum(tokens) > 0),
weight_domain(domain, weight) AS (VALUES ('hub', 2), ('odd', 3), ('even', 3)),
weight_lang(lang, weight) AS (VALUES ('en', 4), ('de', 3), ('fr', 2), ('es', 2)),
nodes1 AS (
    SELECT domain, sum(tokens) * 2 AS capacity, CAST(coalesce(any_value(weight), 1) AS HUGEINT) AS weight, (SELECT CAST(floor(sum(tokens) * 0.6::DOUBLE) AS HUGEINT) FROM leaf) AS budget
    FROM leaf LEFT JOIN weight_domain USING (domain) GROUP BY domain
), share1 AS ({_allot("nodes1", [], "domain")}),
nodes2 AS (
    SELECT leaf.domain, leaf.lang, sum(tokens) * 2 AS capacity, CAST(coalesce(any_value(weight), 1) AS HUGEINT) AS weight, any_value(share) AS budget
    FROM leaf JOIN share1 ON leaf.domain IS NOT DISTINCT FROM share1.domain LEFT JOIN weight_lang ON leaf.lang = weight_lang.lang GROUP BY leaf.domain, leaf.lang
), share2 AS ({_allot("nodes2", ["domain"], "lang")}),
nodes3 AS (
    SELECT leaf.domain, leaf.lang, leaf.source, tokens * 2 AS capacity, CAST(1 AS HUGEINT) AS weight, share AS budget
    FROM leaf JOIN share2 ON leaf.domain IS NOT DISTINCT FROM share2.domain AND leaf.lang IS NOT DISTINCT FROM share2.lang
), share3 AS ({_allot("nodes3", ["domain", "lang"], "source")}),
placed AS (
    SELECT doc.*, leaf.tokens AS all_tokens, share AS budget FROM doc
    JOIN leaf ON doc.domain IS NOT DISTINCT FROM leaf.domain AND doc.lang IS NOT DISTINCT FROM leaf.lang AND doc.source IS NOT DISTINCT FROM leaf.source
    JOIN share3 ON doc.domain IS NOT DISTINCT FROM share3.domain AND doc.lang IS NOT DISTINCT FROM share3.lang AND doc.source IS NOT DISTINCT FROM share3.source
    WHERE doc.tokens > 0
), epochs AS (SELECT placed.*, CAST(epoch AS INT) AS epoch FROM placed, range(0, 3) e(epoch) WHERE epoch * all_tokens < budget),
line AS (
    SELECT *, epoch * all_tokens + coalesce(sum(tokens) OVER (PARTITION BY domain, lang, source, epoch ORDER BY md5('7:' || epoch || ':' || coalesce(CAST(doc_id AS VARCHAR), '-')), doc_id
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM epochs
)
SELECT doc_id, domain, lang, source, epoch, tokens AS n_tokens, CAST(least(tokens, budget - before) AS BIGINT) AS take_tokens FROM line WHERE before < budget
"""

def _found(kind: str, number: int) -> str:
    """Spans (row, kind, s, e) of one kind: gaps and matches are cut out one after another, positions are sums of their lengths."""
    pattern, least = (secret_scan.BASE | secret_scan.WEAK)[kind]
    cut = lambda group: f"unnest(regexp_extract_all(text, '(?s)(.*?)(?:{pattern.replace(chr(39), chr(39) * 2)})', {group}))"
    holds = "".join(f" AND regexp_matches(value, '{h}')" for h in secret_scan.HOLDS.get(kind, []))
    return f"""SELECT row, {number} AS kind, CAST(upto - length(whole) + length(gap) AS BIGINT) AS s, CAST(upto AS BIGINT) AS e FROM (
        SELECT *, sum(length(whole)) OVER (PARTITION BY row ORDER BY nth) AS upto FROM (
            SELECT row, {cut(0)} AS whole, {cut(1)} AS gap, {cut(2)} AS value, {cut(0).replace("unnest(", "generate_subscripts(", 1)[:-1]}, 1) AS nth FROM doc))
        WHERE length(value) >= {least}{holds}"""


def _near(kinds: list[str], known: list[str]) -> str:
    numbers = ", ".join(str(known.index(k)) for k in kinds)
    return f"""EXISTS (SELECT 1 FROM part p WHERE p.row = w.row AND p.kind IN ({numbers}) AND greatest(p.s, w.s) <= CASE WHEN w.s <= p.s THEN w.e ELSE p.e END + {secret_scan.REACH})"""


def _secrets() -> str:
    kinds, bases = secret_scan.KINDS, len(secret_scan.BASE)
    spans = " UNION ALL ".join(_found(k, i) for i, k in enumerate(kinds))
    needs = " OR ".join(
        f"(w.kind = {kinds.index(k)} AND {' AND '.join(_near([x for x in group if x != k], kinds) for group in groups)})" for k, groups in secret_scan.NEEDS.items())
    name = "CASE kind " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(kinds)) + " END"
    line = f"string_agg({name} || ':' || s || ':' || e, ',' ORDER BY s, kind)"
    counts = ", ".join(f"count(*) FILTER (kind = {i}) AS n_{k}" for i, k in enumerate(secret_scan.BASE))
    return f"""
WITH doc AS MATERIALIZED (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
span AS MATERIALIZED ({spans}),
part AS MATERIALIZED (SELECT * FROM span w WHERE kind < {bases} OR NOT EXISTS (SELECT 1 FROM span b WHERE b.kind < {bases} AND b.row = w.row AND b.s < w.e AND w.s < b.e)),
reported AS (SELECT * FROM part w WHERE kind < {bases} OR {needs}),
summed AS (SELECT row, {counts}, count(*) FILTER (kind >= {bases}) AS n_linked, {line.replace("ORDER BY s, kind)", f"ORDER BY s, kind) FILTER (kind < {bases})")} AS base, {line} AS spans FROM reported GROUP BY row)
SELECT doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in secret_scan.BASE)}, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM doc LEFT JOIN summed USING (row)
"""


def _field(value: str) -> str:
    return f"CASE WHEN {value} IS NULL THEN '-' ELSE strlen(CAST({value} AS VARCHAR)) || ':' || {value} END"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(c) for c in ("doc_id", "source", "lang", n_chars, "text")) + ")"


# the checksum bit by bit, as there is no such function
_CRC = """xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT)),
    lambda crc, byte: list_reduce([xor(crc, byte), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, b: xor(x // 2, CASE WHEN x % 2 = 1 THEN 3988292384 ELSE 0 END))))"""

# trees level by level; `one` is the group, the second tree has one group of all subroots
MANIFEST = f"""
WITH RECURSIVE leaf AS MATERIALIZED (
    SELECT doc_id, lang, {_leaf("n_chars")} AS leaf, {_leaf(f"(n_chars + CASE WHEN {_CRC} % 7 = 0 THEN 1 ELSE 0 END)")} AS claim FROM documents
), placed AS MATERIALIZED (
    SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY lang) AS n FROM leaf
), node(lang, level, idx, n, h) AS (
    SELECT lang, 0, idx, n, leaf FROM placed
    UNION ALL SELECT lang, level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM node WHERE n > 1 GROUP BY lang, level, idx // 2, n
), subroot AS MATERIALIZED (SELECT lang, h, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS idx, count(*) OVER () AS n FROM node WHERE n = 1),
top(level, idx, n, h) AS (
    SELECT 0, idx, n, h FROM subroot
    UNION ALL SELECT level + 1, idx // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY idx)) FROM top WHERE n > 1 GROUP BY level, idx // 2, n
), way(doc_id, lang, leaf, start, level, idx, n, folded, proof) AS (
    SELECT doc_id, lang, leaf, idx, 0, idx, n, claim, '' FROM placed
    UNION ALL SELECT doc_id, way.lang, leaf, start, way.level + 1, way.idx // 2, (way.n + 1) // 2,
        sha256(CASE WHEN way.idx % 2 = 1 THEN h || folded ELSE folded || coalesce(h, '') END), proof || coalesce(h, '')
    FROM way LEFT JOIN node ON node.lang IS NOT DISTINCT FROM way.lang AND node.level = way.level AND node.idx = xor(way.idx, 1) WHERE way.n > 1
), onward(doc_id, lang, leaf, start, level, idx, n, folded, proof, subroot) AS (
    SELECT doc_id, way.lang, leaf, start, 0, subroot.idx, subroot.n, folded, proof, h FROM way JOIN subroot ON subroot.lang IS NOT DISTINCT FROM way.lang WHERE way.n = 1
    UNION ALL SELECT doc_id, lang, leaf, start, onward.level + 1, onward.idx // 2, (onward.n + 1) // 2,
        sha256(CASE WHEN onward.idx % 2 = 1 THEN h || folded ELSE folded || coalesce(h, '') END), proof || coalesce(h, ''), subroot
    FROM onward LEFT JOIN top ON top.level = onward.level AND top.idx = xor(onward.idx, 1) WHERE onward.n > 1
)
SELECT doc_id, leaf, subroot, h AS root, sha256(proof) AS proof_sha256, folded AS folded_root, folded = h AS verified
FROM onward, (SELECT h FROM top WHERE n = 1) WHERE n = 1
"""

NEGATIVES = """
WITH sound AS MATERIALIZED (
    SELECT row_number() OVER () AS row, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
        list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v
    FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS MATERIALIZED (
    SELECT a.row AS anchor_row, a.vec_id AS anchor_id, b.row, b.vec_id, a.label = b.label AS alike, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
    FROM sound a JOIN sound b ON a.row <> b.row WHERE a.vec_id % 50 = 0
), positive AS (
    SELECT *, row_number() OVER (PARTITION BY anchor_row ORDER BY score DESC, vec_id, row) AS nth FROM scored WHERE alike QUALIFY nth <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER (PARTITION BY p.anchor_row, p.nth ORDER BY n.score DESC, n.vec_id, n.row) AS INTEGER) AS rank,
    n.vec_id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor_row = p.anchor_row AND NOT n.alike AND 50 * p.score <= 100 * n.score AND 100 * n.score <= 95 * p.score
QUALIFY rank <= 3
"""

REPEATS = f"""
WITH doc AS MATERIALIZED (
    SELECT row_number() OVER () AS row, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{_SPACE}+'), lambda w: w <> '') AS words FROM documents
), place AS MATERIALIZED (SELECT row, i, md5(array_to_string(words[i:i + 34], ' ')) AS h FROM (SELECT row, words, unnest(range(1, len(words) - 33)) AS i FROM doc)),
gone AS MATERIALIZED (
    SELECT DISTINCT row, unnest(range(i, i + 35)) AS i FROM place SEMI JOIN (SELECT h FROM place GROUP BY h HAVING count(*) > 1) again USING (h)
), kept AS (
    SELECT row, string_agg(word, ' ' ORDER BY i) AS line, count(*) AS n
    FROM (SELECT row, unnest(words) AS word, unnest(range(1, len(words) + 1)) AS i FROM doc) ANTI JOIN gone USING (row, i) GROUP BY row
)
SELECT doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(line, '')) AS kept_sha256 FROM doc LEFT JOIN kept USING (row)
"""


ORACLE: dict[str, str] = {
    "op13_substring_dedup": REPEATS,
    "op12_hard_negatives": NEGATIVES,
    "op11_merkle_manifest": MANIFEST,
    "op7_secret_scan": _secrets(),
    "op1_embedding_near_dedup": EMBEDDINGS,
    "op2_source_mixing": MIX,
    "op3_url_filter": URLS,
    "op5_exact_dedup": EXACT,
}
