"""DuckDB SQL for the engine's queries: named common table expressions, put together by the names that they mention."""

from __future__ import annotations

import re

from granary.functions import stem
from granary.functions.text import STOPWORDS
from granary.operators.minhash import PRIME

STOP = "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in STOPWORDS) + "]"
RUNS = r"regexp_extract_all({0}, '[\p{{L}}\p{{N}}_]+')"
RAW = f"list_transform(list_filter({RUNS}, lambda x: regexp_full_match(x, '[a-zA-Z][a-zA-Z0-9]*')), lambda x: lower(x))"
TERMS = f"list_filter({RAW}, lambda x: NOT list_contains({STOP}, x))"
WORDS2 = "list_filter(regexp_extract_all(lower(strip_accents({0})), '[\\p{{L}}\\p{{N}}_]+'), lambda x: length(x) >= 2)"
HALF = "CAST('0x' || substr(md5({0}), {1}, 8) AS BIGINT)"


def pairs_of(words: str) -> str:
    return f"CASE WHEN len({words}) > 1 THEN list_transform(range(1, len({words})), lambda i: {words}[i] || ' ' || {words}[i + 1]) ELSE [] END"


def simhash(tf: str, idf: str, key: str, keys: str) -> str:
    """Fingerprints of tf rows, with zeros for keys without any."""
    sums = ", ".join(f"sum(CASE WHEN ({h} & {1 << i}) <> 0 THEN w ELSE -w END) AS {h}{i}" for h in ("hi", "lo") for i in range(32))
    join = lambda h: " + ".join(f"CASE WHEN {h}{i} > 0 THEN {1 << i}::BIGINT ELSE 0::BIGINT END" for i in range(32))
    return f"""SELECT k.{key}, CAST(coalesce({join('hi')}, 0) AS BIGINT) AS fp_hi, CAST(coalesce({join('lo')}, 0) AS BIGINT) AS fp_lo
        FROM {keys} k LEFT JOIN (SELECT {key}, {sums} FROM (SELECT t.{key}, t.tf * CAST(round(i.idf * 1e6) AS BIGINT) AS w,
        {HALF.format('t.term', 1)} AS hi, {HALF.format('t.term', 9)} AS lo FROM {tf} t JOIN {idf} i USING (term)) GROUP BY 1) s USING ({key})"""


def vectors(grams: str, key: str) -> str:
    raw = f"SELECT {key}, term, (1 + ln(tf)) * idf AS w FROM {grams} JOIN vocab USING (term)"
    return f"SELECT {key}, term, w / sqrt(sum(w * w) OVER (PARTITION BY {key})) AS w FROM ({raw})"


def porter(terms: str) -> dict[str, str]:
    """Expressions that end in stem (term, stem): the Porter stemmer, step by step, over the distinct terms of a query.

    A y that is a consonant is written Y meanwhile, so that letters alone tell vowels.
    """
    v, c = "[aeiouy]", "[^aeiouy]"
    m0, m1 = (lambda x, k=k: f"regexp_matches({x}, '^{c}*" + f"{v}+{c}+" * k + f"{v}+{c}')" for k in (0, 1))
    has = lambda x: f"regexp_matches({x}, '{v}')"
    twin = lambda x, no: f"(length({x}) > 1 AND right({x}, 1) = substr({x}, -2, 1) AND regexp_matches({x}, '{c}$') AND NOT regexp_matches({x}, '[{no}]$'))"
    short = lambda x: f"regexp_matches({x}, '{c}{v}[^aeiouywxY]$')"
    cut = lambda n: f"left(w, -{n})"
    case = lambda arms: "CASE " + " ".join(f"WHEN {a} THEN {b}" for a, b in arms) + " ELSE w END"
    ends = lambda x: f"w LIKE '%{x}'"
    step = lambda rules: case([(ends(x), f"CASE WHEN {m0(cut(len(x)))} THEN {cut(len(x))} || '{to}' ELSE w END") for x, to in sorted(rules, key=lambda r: -len(r[0]))])
    four = sorted(stem.STEP_4.split(), key=len, reverse=True)
    base = f"CASE WHEN {ends('ed')} THEN {cut(2)} WHEN {ends('ing')} THEN {cut(3)} END"
    steps = [
        f"SELECT term, regexp_replace(regexp_replace(term, '^y', 'Y'), '({v})y', '\\1Y', 'g') AS w FROM ({terms}) WHERE length(term) > 2",
        f"SELECT term, {case([(ends('sses') + ' OR ' + ends('ies'), cut(2)), (ends('s') + ' AND NOT ' + ends('ss'), cut(1))])} AS w FROM {{0}}",
        f"SELECT term, CASE WHEN {ends('eed')} THEN CASE WHEN {m0(cut(3))} THEN {cut(1)} ELSE w END WHEN {has(base)} THEN {base} ELSE w END AS w, coalesce(NOT {ends('eed')} AND {has(base)}, false) AS shorter FROM {{0}}",
        f"SELECT term, CASE WHEN NOT shorter THEN w WHEN regexp_matches(w, '(at|bl|iz)$') THEN w || 'e' WHEN {twin('w', 'lsz')} THEN {cut(1)} WHEN {m0('w')} AND NOT {m1('w')} AND {short('w')} THEN w || 'e' ELSE w END AS w FROM {{0}}",
        f"SELECT term, CASE WHEN regexp_matches(w, '[yY]$') AND {has(cut(1))} THEN {cut(1)} || 'i' ELSE w END AS w FROM {{0}}",
        f"SELECT term, {step(stem.RULES_2)} AS w FROM {{0}}",
        f"SELECT term, {step(stem.RULES_3)} AS w FROM {{0}}",
        f"SELECT term, {case([(ends(x), f'CASE WHEN {m1(cut(len(x)))}' + (f' AND regexp_matches({cut(3)}, ' + chr(39) + '[st]$' + chr(39) + ')' if x == 'ion' else '') + f' THEN {cut(len(x))} ELSE w END') for x in four])} AS w FROM {{0}}",
        f"SELECT term, CASE WHEN {ends('e')} AND ({m1(cut(1))} OR ({m0(cut(1))} AND NOT {short(cut(1))})) THEN {cut(1)} ELSE w END AS w FROM {{0}}",
        f"SELECT term, CASE WHEN {m1('w')} AND {twin('w', '0')} AND {ends('l')} THEN {cut(1)} ELSE w END AS w FROM {{0}}",
    ]
    parts = {f"porter_{i}": x.format(f"porter_{i - 1}") if i else x for i, x in enumerate(steps)}
    return parts | {"stem": f"SELECT term, replace(w, 'Y', 'y') AS stem FROM porter_{len(steps) - 1} UNION ALL SELECT term, term FROM ({terms}) WHERE length(term) <= 2"}


def stemmed(tokens: str, key: str) -> str:
    return f"SELECT k.{key}, coalesce(s.terms, []) AS terms FROM {tokens} k LEFT JOIN (SELECT {key}, list(stem ORDER BY pos) AS terms FROM (SELECT {key}, unnest(terms) AS term, unnest(range(len(terms))) AS pos FROM {tokens}) JOIN stem USING (term) GROUP BY 1) s USING ({key})"


def top(rows: str, score: str, k: int | str, by: str = "query_id") -> str:
    return f"SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY round({score}, 9) DESC, chunk_id) AS rank FROM {rows}) WHERE rank <= {k}"


def shaped(rows: str, method: str, score: str, fallback: str = "NULL") -> str:
    return f"SELECT query_id, '{method}' AS method, rank, chunk_id, {score} AS score, CAST({fallback} AS VARCHAR) AS fallback_to FROM ({rows})"


def tfidf(k: int, scores: str = "scores", chunks: str = "chunk", queries: str = "query") -> str:
    found = top(scores, "cosine", k)
    fill = f"SELECT q.query_id, c.chunk_id, 0.0 AS cosine FROM {queries} q, (SELECT chunk_id FROM {chunks} ORDER BY chunk_id LIMIT {2 * k}) c WHERE NOT EXISTS (SELECT 1 FROM ({found}) f WHERE f.query_id = q.query_id AND f.chunk_id = c.chunk_id)"
    both = top(f"(SELECT query_id, chunk_id, cosine FROM ({found}) UNION ALL {fill})", "cosine", k)
    return f"SELECT query_id, 'tfidf' AS method, rank, chunk_id, CASE WHEN best > 0 THEN cosine / best ELSE cosine END AS score, CAST(NULL AS VARCHAR) AS fallback_to FROM (SELECT *, max(cosine) OVER (PARTITION BY query_id) AS best FROM ({both}))"


def scan(k: int, threshold: int | None, method: str = "simhash", fallback: str = "NULL", queries: str = "qfp") -> str:
    d = f"(SELECT q.query_id, c.chunk_id, bit_count(xor(q.fp_hi, c.fp_hi)) + bit_count(xor(q.fp_lo, c.fp_lo)) AS hamming FROM {queries} q, fp c)"
    rows = f"(SELECT *, 1 - hamming / 64.0 AS similarity, min(hamming) OVER (PARTITION BY query_id) AS least FROM {d})"
    keep = "" if threshold is None else f" WHERE least > {threshold} OR hamming <= {threshold}"
    return shaped(f"SELECT * FROM ({top(rows, 'similarity', k)}){keep}", method, "similarity", fallback)


def minhash(k: int) -> str:
    return shaped(top("exact", "jaccard", k), "minhash", "jaccard") + f" UNION ALL SELECT query_id, 'minhash', rank, chunk_id, score, 'tfidf' FROM ({tfidf(k, 'scores', 'chunk', '(SELECT * FROM query WHERE query_id NOT IN (SELECT query_id FROM cand))')}) WHERE query_id NOT IN (SELECT query_id FROM cand)"


def hybrid(k: int, alpha: float = 0.5) -> str:
    rated = f"(SELECT p.query_id, p.chunk_id, {alpha} * p.sig_jaccard + {1 - alpha} * (1 - (bit_count(xor(q.fp_hi, c.fp_hi)) + bit_count(xor(q.fp_lo, c.fp_lo))) / 64.0) AS combined FROM pre p JOIN qfp q USING (query_id) JOIN fp c USING (chunk_id))"
    return shaped(top(rated, "combined", k), "hybrid", "combined") + " UNION ALL " + scan(k, None, "hybrid", "'simhash_scan'", "(SELECT * FROM qfp WHERE query_id NOT IN (SELECT query_id FROM cand))")


def all_methods(k: int, threshold: int = 10) -> str:
    return " UNION ALL ".join([tfidf(k), minhash(k), scan(k, threshold), hybrid(k)])


SIG = f"SELECT {{0}}, slot, min((((slot * 1103515245 + 12345) % {PRIME}) * h + ((slot * 22695477 + 1) % {PRIME})) % {PRIME}) AS value FROM (SELECT {{0}}, {HALF.format('shingle', 1)} % {PRIME} AS h FROM {{1}}), (SELECT CAST(unnest(range({{2}})) AS BIGINT) AS slot) GROUP BY 1, 2"


def pagerank(iterations: int, alpha: float = 0.85) -> dict[str, str]:
    """One expression an iteration."""
    out = {"rank_0": "SELECT chunk_id, 1.0 / (SELECT count(*) FROM chunk) AS rank FROM chunk"}
    for i in range(iterations):
        out[f"rank_{i + 1}"] = f"""SELECT c.chunk_id, {1 - alpha} / n + {alpha} * dangling / n + {alpha} * coalesce(got, 0) AS rank FROM chunk c CROSS JOIN
            (SELECT count(*) AS n FROM chunk) CROSS JOIN (SELECT coalesce(sum(rank), 0) AS dangling FROM rank_{i} WHERE chunk_id NOT IN (SELECT src FROM edge))
            LEFT JOIN (SELECT dst AS chunk_id, sum(rank / o) AS got FROM edge JOIN rank_{i} r ON r.chunk_id = src JOIN (SELECT src, count(*) AS o FROM edge GROUP BY 1) USING (src) GROUP BY 1) g ON g.chunk_id = c.chunk_id"""
    return out


#: Iterations of PageRank that SQL spells out; on 1,000 chunks the changes fall below the tolerance before the last.
ROUNDS = 30
#: The least support of triples in the registered queries (three, as for pairs, makes thousands of millions of them).
TRIPLES = 100

PARTS = {
    "chunk": "SELECT doc_id AS chunk_id, text, source AS source_file FROM documents",
    "query": "SELECT item_id AS query_id, text FROM benchmark",
    "tok": f"SELECT chunk_id, {TERMS.format('text')} AS terms FROM chunk",
    "qtok": f"SELECT query_id, {TERMS.format('text')} AS terms FROM query",
    **porter("SELECT DISTINCT term FROM (SELECT unnest(terms) AS term FROM tok UNION ALL SELECT unnest(terms) AS term FROM qtok)"),
    "stok": stemmed("tok", "chunk_id"),
    "qstok": stemmed("qtok", "query_id"),
    "stf": "SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM stok) GROUP BY 1, 2",
    "sidf": "SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM chunk)) / (1 + count(*))) + 1 AS idf FROM stf GROUP BY 1",
    "tf": "SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(terms) AS term FROM tok) GROUP BY 1, 2",
    "qtf": "SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(terms) AS term FROM qtok) GROUP BY 1, 2",
    "idf": "SELECT term, count(*) AS df, ln((1.0 + (SELECT count(*) FROM chunk)) / (1 + count(*))) + 1 AS idf FROM tf GROUP BY 1",
    "gram": f"SELECT chunk_id, term, count(*) AS tf FROM (SELECT chunk_id, unnest(list_concat(w, {pairs_of('w')})) AS term FROM (SELECT chunk_id, {WORDS2.format('text')} AS w FROM chunk)) GROUP BY 1, 2",
    "qgram": f"SELECT query_id, term, count(*) AS tf FROM (SELECT query_id, unnest(list_concat(w, {pairs_of('w')})) AS term FROM (SELECT query_id, {WORDS2.format('text')} AS w FROM query)) GROUP BY 1, 2",
    "vocab": "SELECT term, df, cf, ln((1.0 + (SELECT count(*) FROM chunk)) / (1 + df)) + 1 AS idf FROM (SELECT term, count(*) AS df, CAST(sum(tf) AS BIGINT) AS cf FROM gram GROUP BY 1) WHERE df >= 2 AND df <= 0.85 * (SELECT count(*) FROM chunk) ORDER BY cf DESC, term LIMIT 20000",
    "vec": vectors("gram", "chunk_id"),
    "qvec": vectors("qgram", "query_id"),
    "scores": "SELECT q.query_id, v.chunk_id, sum(v.w * q.w) AS cosine FROM vec v JOIN qvec q USING (term) GROUP BY 1, 2",
    "shingle": f"SELECT DISTINCT chunk_id, unnest(list_concat(terms, {pairs_of('terms')})) AS shingle FROM stok",
    "qshingle": f"SELECT DISTINCT query_id, unnest(list_concat(terms, {pairs_of('terms')})) AS shingle FROM qstok",
    "sig": SIG.format("chunk_id", "shingle", 128),
    "qsig": SIG.format("query_id", "qshingle", 128),
    "cand": "SELECT q.query_id, s.chunk_id, count(*) AS bands, count(*) / 128.0 AS sig_jaccard FROM sig s JOIN qsig q ON q.slot = s.slot AND q.value = s.value GROUP BY 1, 2",
    "pre": f"SELECT query_id, chunk_id, bands, sig_jaccard FROM ({top('cand', 'sig_jaccard', 50)})",
    "qsize": "SELECT query_id, count(*) AS qn FROM qshingle GROUP BY 1",
    "csize": "SELECT chunk_id, count(*) AS cn FROM shingle GROUP BY 1",
    "exact": "SELECT p.query_id, p.chunk_id, coalesce(b, 0) / (qn + cn - coalesce(b, 0)) AS jaccard FROM pre p JOIN qsize USING (query_id) JOIN csize USING (chunk_id) LEFT JOIN (SELECT p.query_id, p.chunk_id, count(*) AS b FROM pre p JOIN qshingle q USING (query_id) JOIN shingle s ON s.chunk_id = p.chunk_id AND s.shingle = q.shingle GROUP BY 1, 2) m ON m.query_id = p.query_id AND m.chunk_id = p.chunk_id",
    "fp": simhash("tf", "idf", "chunk_id", "chunk"),
    "qfp": simhash("qtf", "idf", "query_id", "query"),
    "near": "SELECT a.chunk_id AS a, b.chunk_id AS b, CAST(bit_count(xor(a.fp_hi, b.fp_hi)) + bit_count(xor(a.fp_lo, b.fp_lo)) AS INTEGER) AS hamming FROM fp a, fp b WHERE a.chunk_id < b.chunk_id AND bit_count(xor(a.fp_hi, b.fp_hi)) + bit_count(xor(a.fp_lo, b.fp_lo)) <= 4",
    "edge": "SELECT a AS src, b AS dst FROM near UNION ALL SELECT b, a FROM near",
    **pagerank(ROUNDS),
    "change": " UNION ALL ".join(f"SELECT {i} AS i, sum(abs(x.rank - y.rank)) AS change FROM rank_{i} x JOIN rank_{i - 1} y USING (chunk_id)" for i in range(1, ROUNDS + 1)),
    "last": "SELECT min(i) AS last FROM change WHERE change < 1e-6 * (SELECT count(*) FROM chunk)",
    "rank_last": " UNION ALL ".join(f"SELECT chunk_id, rank FROM rank_{i} WHERE {i} = (SELECT last FROM last)" for i in range(1, ROUNDS + 1)),
    "pr": "SELECT chunk_id, CASE WHEN (SELECT max(rank) FROM rank_last) > (SELECT min(rank) FROM rank_last) THEN (rank - (SELECT min(rank) FROM rank_last)) / ((SELECT max(rank) FROM rank_last) - (SELECT min(rank) FROM rank_last)) ELSE 0.0 END AS pagerank FROM rank_last",
    "qrel": "SELECT q.query_id, c.chunk_id FROM query q, chunk c WHERE contains(c.text, q.text)",
    "res": all_methods(10),
    "res5": all_methods(5),
    "method": "SELECT unnest(['tfidf', 'minhash', 'simhash', 'hybrid']) AS method",
    "judged": "SELECT r.*, CASE WHEN l.chunk_id IS NULL THEN 0 ELSE 1 END AS hit FROM res r LEFT JOIN qrel l ON l.query_id = r.query_id AND l.chunk_id = r.chunk_id",
    "perq": """SELECT m.method, q.query_id, CASE WHEN n > 0 THEN coalesce(h, 0) / 5.0 ELSE 0.0 END AS precision, CASE WHEN n > 0 THEN coalesce(h, 0) / n ELSE 0.0 END AS recall, CASE WHEN n > 0 THEN coalesce(g, 0) / n ELSE 0.0 END AS average_precision
        FROM query q CROSS JOIN method m LEFT JOIN (SELECT query_id, count(*) AS n FROM qrel GROUP BY 1) l ON l.query_id = q.query_id
        LEFT JOIN (SELECT method, query_id, sum(hit) AS h, sum(hit * run / rank) AS g FROM (SELECT *, sum(hit) OVER (PARTITION BY method, query_id ORDER BY rank ROWS UNBOUNDED PRECEDING) AS run FROM judged WHERE rank <= 5) GROUP BY 1, 2) s ON s.method = m.method AND s.query_id = q.query_id""",
    "item": "SELECT term AS a, count(*) AS support FROM stf GROUP BY 1 HAVING count(*) >= 3",
    "fterm": "SELECT chunk_id, term FROM stf WHERE term IN (SELECT a FROM item)",
    "pair": "SELECT x.term AS a, y.term AS b, count(*) AS support FROM fterm x JOIN fterm y ON x.chunk_id = y.chunk_id AND x.term < y.term GROUP BY 1, 2 HAVING count(*) >= 3",
    "fterm_3": f"SELECT chunk_id, term FROM stf WHERE term IN (SELECT a FROM item WHERE support >= {TRIPLES})",
    "pair_3": f"SELECT a, b FROM pair WHERE support >= {TRIPLES}",
    "triple": f"SELECT p.a, p.b, z.term AS c, count(*) AS support FROM pair_3 p JOIN fterm_3 x ON x.term = p.a JOIN fterm_3 y ON y.chunk_id = x.chunk_id AND y.term = p.b JOIN fterm_3 z ON z.chunk_id = x.chunk_id AND z.term > p.b GROUP BY 1, 2, 3 HAVING count(*) >= {TRIPLES}",
    "sig_256": SIG.format("chunk_id", "shingle", 256),
    "qsig_256": SIG.format("query_id", "qshingle", 256),
    "coocw": "SELECT c.term, c.co_term, support, idf, support * idf AS weight, CAST(row_number() OVER (PARTITION BY c.term ORDER BY round(support * idf, 9) DESC, co_term) AS INTEGER) AS place FROM cooc c JOIN (SELECT term AS co_term, idf FROM sidf) USING (co_term)",
    "cooc": "SELECT term, co_term, CAST(sum(support) AS BIGINT) AS support FROM (SELECT unnest([a, b]) AS term, unnest([b, a]) AS co_term, support FROM pair UNION ALL SELECT unnest([a, a, b, b, c, c]), unnest([b, c, a, c, a, b]), support FROM triple) GROUP BY 1, 2",
}


def query(body: str) -> str:
    """body with the parts that it needs, directly or through others, before it."""
    need: dict[str, None] = {}

    def visit(text: str) -> None:
        for name in PARTS:
            if name not in need and re.search(rf"(?:FROM|JOIN|,)\s*\(?\s*{name}\b", text) and name not in need:
                need[name] = None
                visit(PARTS[name])

    visit(body)
    order = [p for p in PARTS if p in need]
    done: list[str] = []

    def place(name: str) -> None:
        if name in done:
            return
        for other in order:
            if other != name and re.search(rf"(?:FROM|JOIN|,)\s*\(?\s*{other}\b", PARTS[name]):
                place(other)
        done.append(name)

    for p in order:
        place(p)
    heavy = {"tok", "tf", "sig", "qsig", "cand", "pre", "vocab", "gram", "vec", "qvec", "scores", "fp", "qfp", "near", "edge", "shingle", "res", "res5", "fterm", "pair", "item", "triple", "idf"} | {f"rank_{i}" for i in range(ROUNDS + 1)} | {f"porter_{i}" for i in range(10)} | {"stem", "stok", "qstok", "stf", "rank_last", "change", "cooc", "coocw", "sig_256", "qsig_256", "sidf", "pair_3", "fterm_3"}
    parts = [f"{p} AS {'MATERIALIZED ' if p in heavy else ''}({PARTS[p]})" for p in done]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body
