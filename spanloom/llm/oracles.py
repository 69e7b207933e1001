"""DuckDB SQL for those of the queries whose whole result SQL can say: strings and windows in two documents, archives, fingerprints."""

from __future__ import annotations

#: Runs of shared strings, given ``hit`` (doc_id, at) with the places where a string of 50 starts that a smaller document has,
#: and what lies before, between and behind them. Places count from 0.
_RUNS = """step AS (
  SELECT doc_id, place, CASE WHEN place <= lag(place) OVER (PARTITION BY doc_id ORDER BY place) + 50 THEN 0 ELSE 1 END AS opens FROM hit
), numbered AS (
  SELECT doc_id, place, sum(opens) OVER (PARTITION BY doc_id ORDER BY place) AS run FROM step
), runs AS (
  SELECT doc_id, min(place) AS a, max(place) + 50 AS z FROM numbered GROUP BY doc_id, run
), gaps AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM runs
  UNION ALL
  SELECT d.doc_id, coalesce(max(r.z), 0) AS a, any_value(d.n) AS z FROM d LEFT JOIN runs r ON r.doc_id = d.doc_id GROUP BY d.doc_id
), gone AS (
  SELECT doc_id, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY doc_id
)"""

OP1_SQL = f"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, CAST(octet_length(encode(coalesce(text, ''))) AS BIGINT) AS n FROM documents
), places AS (
  SELECT doc_id, h, unnest(range(n // 1024 + 1)) AS c FROM d
), parts AS (
  SELECT doc_id, c, substr(h, 2048 * c + 1, 2048 + 98) AS part FROM places
), strings AS (
  SELECT doc_id, 1024 * c + i AS place, substr(part, 2 * i + 1, 100) AS w FROM parts, range(1024) t(i) WHERE length(part) >= 2 * i + 100
), leads AS (
  SELECT w, min(doc_id) AS lead FROM strings GROUP BY w
), hit AS (
  SELECT doc_id, place FROM strings JOIN leads USING (w) WHERE doc_id > lead
), {_RUNS}, kept AS (
  SELECT d.doc_id, string_agg(substr(d.h, 2 * g.a + 1, 2 * (g.z - g.a)), '' ORDER BY g.a) AS h FROM d JOIN gaps g ON g.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, d.n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(kept.h)) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id
"""

OP2_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS body FROM pages
), f AS (
  SELECT page_id, body, sha1(body) AS h, min(page_id) OVER (PARTITION BY body) AS lead FROM p
)
SELECT page_id, CAST(octet_length(body) AS BIGINT) AS payload_bytes,
       array_to_string(list_transform(range(32), lambda j: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         ((CAST('0x' || substr(h, CAST(5 * (j // 4) + 1 AS BIGINT), 5) AS BIGINT) // CAST(power(32, 3 - j % 4) AS BIGINT)) % 32) + 1, 1)), '') AS payload_digest,
       CASE WHEN page_id = lead THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id = lead THEN NULL ELSE lead END AS refers_to
FROM f
"""

OP10_SQL = f"""
WITH d AS (
  SELECT doc_id, w, CAST(len(w) AS BIGINT) AS n FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents)
), places AS (
  SELECT doc_id, w, unnest(range(n // 256 + 1)) AS c FROM d
), parts AS (
  SELECT doc_id, c, w[256 * c + 1 : 256 * c + 256 + 49] AS part FROM places
), strings AS (
  SELECT doc_id, 256 * c + i AS place, array_to_string(part[i + 1 : i + 50], ' ') AS w FROM parts, range(256) t(i) WHERE len(part) >= i + 50
), leads AS (
  SELECT w, min(doc_id) AS lead FROM strings GROUP BY w
), hit AS (
  SELECT doc_id, place FROM strings JOIN leads USING (w) WHERE doc_id > lead
), {_RUNS}, kept AS (
  SELECT d.doc_id, coalesce(string_agg(array_to_string(d.w[g.a + 1 : g.z], ' '), ' ' ORDER BY g.a) FILTER (g.z > g.a), '') AS t
  FROM d JOIN gaps g ON g.doc_id = d.doc_id GROUP BY d.doc_id
)
SELECT d.doc_id, d.n AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(kept.t) AS kept_sha256
FROM d JOIN kept ON kept.doc_id = d.doc_id LEFT JOIN gone ON gone.doc_id = d.doc_id
"""

# Fixed values of XXH64.
_P = (11400714785074694791, 14029467366897019727, 1609587929392839161, 9650029242287828579, 2870177450012600261)
_ALL = 1 << 64


def _u(x: int | str) -> str:
    return f"CAST({x} AS UHUGEINT)"


def _low(x: str) -> str:
    """What is left of a value of 128 bits in 64."""
    return f"CAST(({x}) % {_u(_ALL)} AS UBIGINT)"


def _times(x: str, k: int) -> str:
    return _low(f"{_u(x)} * {_u(_P[k - 1])}")


def _plus(*x: str | int) -> str:
    return _low(" + ".join(map(_u, x)))


def _turned(x: str, bits: int) -> str:
    """``x`` rotated left: the two halves of a product with a power of two."""
    return f"CAST({_u(x)} * {_u(1 << bits)} % {_u(_ALL)} + {_u(x)} // {_u(1 << (64 - bits))} AS UBIGINT)"


def _number(at: str, size: int) -> str:
    """The little-endian number of ``size`` bytes of the hex digits ``x`` from byte ``at`` on."""
    digits = " || ".join(f"substr(x, 2 * ({at} + {k}) + 1, 2)" for k in reversed(range(size)))
    return f"CAST('0x' || {digits} AS UBIGINT)"


def _lane(x: str) -> str:
    return _times(_turned(_times(x, 2), 31), 1)


def _folded(numbers: str, step: str, first: str) -> str:
    return f"list_reduce({numbers}, lambda v, y: {step}, CAST({first} AS UBIGINT))"


def _numbers(count: str, at: str, size: int) -> str:
    return f"list_transform(range({count}), lambda s: {_number(at, size)})"


def _xxh64(seed: int) -> str:
    """Columns that end in ``h``, the XXH64 of the bytes whose hex digits are ``x`` and whose number is ``n``; a column may use earlier ones."""
    starts = [seed + _P[0] + _P[1], seed + _P[1], seed, seed - _P[0]]
    lines = [
        f"{_folded(_numbers('n // 32', f'(32 * s + {8 * k})', 8), _times(_turned(_plus('v', _times('y', 2)), 31), 1), str(start % _ALL))} AS v{k}"
        for k, start in enumerate(starts)
    ]
    joined = _plus(*(_turned(f"v{k}", bits) for k, bits in enumerate((1, 7, 12, 18))))
    lines.append(f"CASE WHEN n >= 32 THEN {joined} ELSE CAST({(seed + _P[4]) % _ALL} AS UBIGINT) END AS h0")
    lines.append(_folded("CASE WHEN n >= 32 THEN [v0, v1, v2, v3] ELSE [] END", _plus(_times(f"xor(v, {_lane('y')})", 1), _P[3]), "h0") + " AS h1")
    lines.append(f"{_plus('h1', 'n')} AS h2")
    lines.append(_folded(_numbers("n % 32 // 8", "(n // 32 * 32 + 8 * s)", 8), _plus(_times(_turned(f"xor(v, {_lane('y')})", 27), 1), _P[3]), "h2") + " AS h3")
    lines.append(_folded(_numbers("n % 8 // 4", "(n // 8 * 8 + 4 * s)", 4), _plus(_times(_turned(f"xor(v, {_times('y', 1)})", 23), 2), _P[2]), "h3") + " AS h4")
    lines.append(_folded(_numbers("n % 4", "(n // 4 * 4 + s)", 1), _times(_turned(f"xor(v, {_times('y', 5)})", 11), 1), "h4") + " AS h5")
    lines += [f"{_times('xor(h5, h5 >> 33)', 2)} AS h6", f"{_times('xor(h6, h6 >> 29)', 3)} AS h7", "xor(h7, h7 >> 32) AS h"]
    return ",\n         ".join(lines)


OP4_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), places AS (
  SELECT doc_id, w, unnest(range(greatest(len(w) - 2, 1) // 256 + 1)) AS c FROM d WHERE len(w) > 0
), parts AS (
  SELECT doc_id, len(w) AS words, w[256 * c + 1 : 256 * c + 258] AS part FROM places
), shingles AS (
  SELECT doc_id, array_to_string(part[i + 1 : i + 3], ' ') AS t FROM parts, range(256) g(i) WHERE len(part) >= i + 3 OR (words < 3 AND i = 0)
), counted AS (
  SELECT doc_id, t, count(*) AS times FROM shingles GROUP BY doc_id, t
), spelt AS (
  SELECT t, hex(encode(t)) AS x, CAST(octet_length(encode(t)) AS BIGINT) AS n FROM (SELECT DISTINCT t FROM counted)
), hashed AS (
  SELECT t, h FROM (
  SELECT t, {_xxh64(42)}
  FROM spelt)
), sums AS (
  SELECT doc_id, sum(times) AS total, {", ".join(f"sum(times) FILTER ((h >> {k}) % 2 = 1) AS b{k}" for k in range(64))}
  FROM counted JOIN hashed USING (t) GROUP BY doc_id
), prints AS (
  SELECT d.doc_id, CAST({" + ".join(f"CASE WHEN 2 * b{k} > total THEN {_u(1 << k)} ELSE {_u(0)} END" for k in range(64))} AS UBIGINT) AS fp
  FROM d LEFT JOIN sums ON sums.doc_id = d.doc_id
), own AS (
  SELECT fp, min(doc_id) AS least FROM prints GROUP BY fp
), near AS (
  SELECT a.fp AS fp, b.fp AS other FROM own a JOIN own b ON bit_count(xor(a.fp, b.fp)) <= 3
), reach AS (
  SELECT fp, fp AS other FROM own UNION SELECT reach.fp, near.other FROM reach JOIN near ON near.fp = reach.other
), named AS (
  SELECT reach.fp, min(own.least) AS component_id FROM reach JOIN own ON own.fp = reach.other GROUP BY reach.fp
)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, component_id FROM prints JOIN named USING (fp)
"""
