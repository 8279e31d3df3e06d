"""DuckDB SQL for the registered queries, written from the semantics."""

from __future__ import annotations

# Fixed values, stated here again so that a slip in the library shows: RE2 patterns, month names, categories, colours, scores, qualities.
W = r"\t\n\x0b\x0c\r \x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}"
WS = f"[{W}]+"
MONTHS = (
    "januari februari maret april mei juni juli agustus september oktober november desember january february march may june july august october december "
    "jan feb mar apr jun jul aug sep oct nov dec"
).split()
_DATE = r"(?:0?[1-9]|[12][0-9]|3[01])[/.-](?:0?[1-9]|1[0-2])[/.-](?:19|20)[0-9]{2}"
# RE2 folds case by Unicode, so both cases of ASCII letters are spelled out.
_MONTH = "|".join("".join(f"[{c.upper()}{c}]" for c in m) for m in MONTHS)
PATTERNS = {
    "nik": rf"\b(?:(?:[0-9]{{4}}[{W}.-]){{3}}[0-9]{{4}}|[0-9]{{16}})\b",
    "phone": rf"\b(?:\+?62[{W}-]?8[0-9]{{8,11}}|08[0-9]{{8,11}}|\(?0[0-9]{{2,4}}\)?[{W}.-]?[0-9]{{6,8}})\b",
    "email": r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b",
    "dob": rf"\b(?:{_DATE}|(?:0?[1-9]|[12][0-9]|3[01])[{W}]+(?:{_MONTH})[{W}]+(?:19|20)[0-9]{{2}})\b",
    "ttl": rf"\b[A-Za-z]{{3,18}},[{W}]*{_DATE}\b",
    "npwp": r"\b[0-9]{2}\.[0-9]{3}\.[0-9]{3}\.[0-9]-[0-9]{3}\.[0-9]{3}\b",
    "bpjs": r"\b000[0-9]{10}\b",
    "bank": r"\b[0-9]{10,16}\b",
    "id": r"\b[A-Za-z]{1,2}[0-9]{7,8}\b",
}
CATEGORIES = [
    ("nik", "NIK (KTP)"), ("phone", "Phone number"), ("email", "E-mail address"), ("dob", "Date of birth"), ("ttl", "Place and date of birth"), ("npwp", "Tax number"),
    ("bpjs", "Health insurance number"), ("bank", "Bank account"), ("id", "Passport or document number"),
]
COLOURS = {"#000000": "Black", "#ffffff": "White", "#374151": "Grey", "#1e3a8a": "Navy", "#b91c1c": "Red"}
FACE_SCORES = [0.6, 0.55, 0.5]
QUALITY = {"image": (0.98, 0.78, 0.89), "scanned": (0.95, 0.75, 0.86), "merge": (0.96, 0.76, 0.88)}

NOISE = r"[-_~—|•*#:=;,.\\/]+"
CLEANED = r"""["''“”:=;,./#()\\\]^_]"""
MONTH_LIST = ", ".join(f"'{m}'" for m in MONTHS)


def fuzzy(t: str) -> str:
    return f"translate({t}, 'OoIl|SB', '0011158')"


def clean(t: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({t}), '{CLEANED}', ' ', 'g'), '{WS}', ' ', 'g'))"


def hits(kind: str, t: str) -> str:
    p = PATTERNS["dob" if kind == "date" else kind]
    return "(" + " OR ".join(f"regexp_matches({x}, '{p}')" for x in (t, fuzzy(t), clean(t))) + ")"


def noise(t: str) -> str:
    return f"regexp_full_match({t}, '{NOISE}')"


def cats(t: str) -> str:
    """List of categories of a token expression."""
    found = ", ".join(f"CASE WHEN {hits(kind, t)} THEN '{kind}' END" for kind, _ in CATEGORIES)
    return f"CASE WHEN {t} = '' OR {noise(t)} THEN [] ELSE list_filter([{found}], lambda x: x IS NOT NULL) END"


def digits(t: str) -> str:
    return f"regexp_replace({t}, '[^0-9]', '', 'g')"


def split_date(t1: str, t2: str, t3: str) -> str:
    return (
        f"(regexp_full_match({digits(t1)}, '0?[1-9]|[12][0-9]|3[01]') AND regexp_replace(lower({t2}), '[^a-z]', '', 'g') IN ({MONTH_LIST})"
        f" AND regexp_full_match({digits(t3)}, '(19|20)[0-9][0-9]'))"
    )


def tokens(relation: str = "documents", key: str = "doc_id", text: str = "text") -> str:
    parts = f"regexp_split_to_array({text}, '{WS}')"
    return f"(SELECT {key}, p - 1 AS pos, token FROM (SELECT {key}, unnest({parts}) AS token, generate_subscripts({parts}, 1) AS p FROM {relation}) WHERE token <> '')"


ORD = "CASE category " + " ".join(f"WHEN '{kind}' THEN {k}" for k, (kind, _) in enumerate(CATEGORIES)) + " END"
LABEL = "CASE category " + " ".join(f"WHEN '{kind}' THEN '{label}'" for kind, label in CATEGORIES) + " END"

LINES = "(SELECT doc_id, i - 1 AS line, s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents))"

DOCUMENT_CATEGORIES = f"""
tk AS (
  SELECT doc_id, line, p, t FROM (
    SELECT doc_id, line, unnest(regexp_split_to_array(s, '{WS}')) AS t, generate_subscripts(regexp_split_to_array(s, '{WS}'), 1) AS p FROM {LINES})
  WHERE t <> '' AND NOT {noise('t')}
),
w AS (SELECT doc_id, line, t, row_number() OVER (PARTITION BY doc_id ORDER BY line, p) - 1 AS word_index FROM tk),
n AS (
  SELECT doc_id, word_index, t, line, lead(t, 1) OVER o AS t2, lead(t, 2) OVER o AS t3, lead(line, 1) OVER o AS l2, lead(line, 2) OVER o AS l3 FROM w
  WINDOW o AS (PARTITION BY doc_id ORDER BY word_index)
),
heads AS (SELECT doc_id, word_index FROM n WHERE line = l2 AND line = l3 AND {split_date('t', 't2', 't3')}),
found AS (
  SELECT doc_id, word_index, unnest({cats('t')}) AS category FROM w
  UNION SELECT doc_id, word_index + unnest([0, 1, 2]), 'dob' FROM heads
)"""

DATE_WORDS = """
dw AS (
  SELECT o_orderkey AS doc_id, i - 1 AS word_index, t AS text,
         CASE WHEN o_orderkey % 5 = 0 AND i >= 3 THEN 2 WHEN i = 2 THEN 0 END AS page_index,
         CASE WHEN o_orderkey % 3 = 0 AND i >= 4 THEN 22.0 ELSE 0.0 END AS y, 18.0 AS height
  FROM (SELECT o_orderkey, unnest(['on', CAST(day(o_orderdate) AS VARCHAR), strftime(o_orderdate, '%b'), CAST(year(o_orderdate) AS VARCHAR), '12']) AS t, generate_series(1, 5) AS s, unnest(generate_series(1, 5)) AS i FROM orders)
),
dn AS (
  SELECT *, CASE WHEN coalesce(page_index, 0) = 0 THEN 1 ELSE page_index END AS page FROM dw
),
dx AS (
  SELECT *, lead(text, 1) OVER o AS t2, lead(text, 2) OVER o AS t3, lead(page, 1) OVER o AS p2, lead(page, 2) OVER o AS p3, lead(y, 1) OVER o AS y2, lead(y, 2) OVER o AS y3
  FROM dn WINDOW o AS (PARTITION BY doc_id ORDER BY word_index)
),
""" + f"""
dh AS (
  SELECT doc_id, word_index FROM dx
  WHERE page = p2 AND page = p3 AND abs(y2 - y) < greatest(height, 22) AND abs(y3 - y) < greatest(height, 22) AND {split_date('text', 't2', 't3')}
),
dm AS (SELECT DISTINCT doc_id, word_index + unnest([0, 1, 2]) AS word_index FROM dh)"""  # fmt: skip

AUTO = f"""{DATE_WORDS},
ow AS (
  SELECT (event_id % 1000) + 1 AS doc_id, CAST(user_id % 5 AS INTEGER) AS word_index, arg_max(CASE WHEN event_id % 3 = 0 THEN 'unredact' ELSE 'redact' END, event_id) AS action
  FROM events GROUP BY 1, 2
),
au AS (
  SELECT dn.*, dm.doc_id IS NOT NULL OR len({cats('text')}) > 0 AS auto FROM dn LEFT JOIN dm ON dn.doc_id = dm.doc_id AND dn.word_index = dm.word_index
),
de AS (
  SELECT au.*, CASE action WHEN 'unredact' THEN false WHEN 'redact' THEN true ELSE auto END AS redacted FROM au LEFT JOIN ow ON au.doc_id = ow.doc_id AND au.word_index = ow.word_index
)"""

BOXES = "(SELECT l_orderkey AS doc_id, l_linenumber AS word_index, l_linenumber * 60.0::DOUBLE AS x, l_quantity * 0.5 AS y, l_quantity + 10 AS width, 14.0::DOUBLE + l_linenumber AS height FROM lineitem)"

CANDIDATES = "(SELECT label AS page, vec_id AS cand_index, abs(embedding[1])::DOUBLE * 1000 AS x, abs(embedding[2])::DOUBLE * 1000 AS y, abs(embedding[3])::DOUBLE * 400 + 40 AS w, abs(embedding[4])::DOUBLE * 400 + 40 AS h, abs(embedding[5])::DOUBLE AS score FROM embeddings)"
PLAUSIBLE = "w >= 10 AND h >= 10 AND w <= 950 AND h <= 950 AND w / h >= 0.45 AND w / h <= 1.9"
REGIONS = f"(SELECT cand_index % 100 AS doc_id, page AS page_index, cand_index AS region_index, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM {CANDIDATES})"
ACTIVE = f"(SELECT doc_id, page_index, region_index, CASE WHEN region_index % 3 = 0 THEN 'manual' ELSE 'face' END AS kind, x, y, w, h FROM {REGIONS} WHERE region_index % 3 = 0 OR region_index % 7 <> 0)"


def synthetic(relation: str, key: str, token: str) -> str:
    nik_dob = f"{hits('nik', 'token')} OR {hits('dob', 'token')}"
    return f"SELECT {key} AS key, token, array_to_string({cats('token')}, ',') AS categories, {nik_dob} AS nik_or_dob FROM (SELECT *, {token} AS token FROM {relation})"


def round6(**columns: str) -> str:
    return ", ".join(f"round({v}, 6) AS {k}" for k, v in columns.items())


def half_up(x: str) -> str:
    return f"floor({x} + 0.5)"


_INSPECT = """
it AS (SELECT doc_id, (i - 1) // 10 + 1 AS page_num, s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS s, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents)),
pg AS (SELECT doc_id, page_num, bool_or(contains(s, '!')) AS img FROM it GROUP BY ALL),
ins AS (
  SELECT p.doc_id, p.total_pages, coalesce(t.n, 0) AS total_text_items, p.has_images, coalesce(t.n, 0) / p.sampled >= 8 AS is_text_dominant
  FROM (SELECT doc_id, count(*) AS total_pages, count(*) FILTER (page_num <= 5) AS sampled, bool_or(img) FILTER (page_num <= 5) AS has_images FROM pg GROUP BY doc_id) p
  LEFT JOIN (SELECT doc_id, count(*) AS n FROM it WHERE page_num <= 5 AND trim(s, chr(32) || chr(9) || chr(13) || chr(160)) <> '' GROUP BY doc_id) t USING (doc_id)
)"""

_BYTES = "CASE WHEN k % 4 = 0 THEN k % 1025 WHEN k % 4 = 1 THEN k * 1000 WHEN k % 4 = 2 THEN k * 1048576 ELSE k * 40000000 END"


def _bytes_label(n: str) -> str:
    out = []
    for k, unit in reversed(list(enumerate(["B", "KB", "MB", "GB", "TB"]))):
        out.append(f"WHEN {n} >= {1024**k} THEN regexp_replace(printf('%.1f', round({n} / {float(1024**k)}, 1)), '[.]0$', '') || ' {unit}'")
    return f"CASE WHEN {n} IS NULL OR {n} = 0 THEN '0 B' {' '.join(out)} END"


_FILE = "SELECT page_id, page_id % 3 AS k, CASE WHEN page_id % 7 = 0 THEN '' WHEN page_id % 7 = 1 THEN ' .pdf' ELSE url END AS name FROM pages"


def _file_name(pages: int, custom: str | None = None) -> str:
    base = "trim(regexp_replace(name, '[.][^.]*$', ''))"
    default = f"CASE WHEN k = 0 THEN '{'redacted-images' if pages > 1 else 'redacted-image'}' ELSE 'redacted-pdf' END"
    ext = f"'{custom}'" if custom else "CASE WHEN name = '' THEN '.pdf' WHEN contains(name, '.') THEN regexp_extract(name, '[.][^.]*$') WHEN k = 0 THEN '.jpg' ELSE '.pdf' END"
    return f"""regexp_replace(CASE WHEN {base} <> '' THEN {base} ELSE {default} END, '[/\\\\?%*:|"<>]', '_', 'g') || {ext}"""


def _nms() -> str:
    inter = "greatest(0, least(c.x + c.w, e.x + e.w) - greatest(c.x, e.x)) * greatest(0, least(c.y + c.h, e.y + e.h) - greatest(c.y, e.y))"
    dup = f"({inter}) > 0 AND (({inter}) / (c.w * c.h) > 0.5 OR ({inter}) / (e.w * e.h) > 0.5 OR ({inter}) / (c.w * c.h + e.w * e.h - ({inter})) > 0.2 OR sqrt(pow(c.x + c.w / 2 - (e.x + e.w / 2), 2) + pow(c.y + c.h / 2 - (e.y + e.h / 2), 2)) < (greatest(c.w, c.h) + greatest(e.w, e.h)) / 4 * 0.65)"
    return f"""
WITH RECURSIVE r AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY score DESC, cand_index) AS k FROM {CANDIDATES} WHERE {PLAUSIBLE}),
d AS (SELECT c.page, c.k AS ck, e.k AS ek FROM r c JOIN r e ON c.page = e.page AND e.k < c.k WHERE {dup}),
m AS (SELECT page, max(k) AS n FROM r GROUP BY page),
f AS (
  SELECT page, 0 AS k, CAST([] AS BIGINT[]) AS taken FROM m
  UNION ALL
  SELECT f.page, f.k + 1, CASE WHEN EXISTS (SELECT 1 FROM d WHERE d.page = f.page AND d.ck = f.k + 1 AND list_contains(f.taken, d.ek)) THEN f.taken ELSE list_append(f.taken, f.k + 1) END
  FROM f JOIN m ON f.page = m.page WHERE f.k < m.n
)
SELECT r.page, r.cand_index FROM (SELECT page, unnest(taken) AS k FROM f JOIN m USING (page) WHERE f.k = m.n) t JOIN r ON r.page = t.page AND r.k = t.k"""


def oracle_sql() -> dict[str, str]:
    word_places = f"""
WITH ln AS (SELECT doc_id, line, s, 10.0 AS vx, line * 22.0 + 0.25 AS top, length(s) * 7.25 AS iw FROM {LINES} WHERE trim(s, chr(32) || chr(9) || chr(13) || chr(160)) <> ''),
pc AS (SELECT doc_id, line, vx, top, iw / length(s) AS each, unnest(regexp_extract_all(s, '[{W}]+|[^{W}]+')) AS t, generate_subscripts(regexp_extract_all(s, '[{W}]+|[^{W}]+'), 1) AS p FROM ln),
placed AS (SELECT *, coalesce(sum(length(t)) OVER (PARTITION BY doc_id, line ORDER BY p ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS o FROM pc)
SELECT doc_id, CAST(line AS INTEGER) AS line, CAST(o AS BIGINT) AS char_offset, t AS text, CAST({half_up('vx + o * each - 1.5')} AS DOUBLE) AS x, CAST(greatest(0, {half_up('top - 1')}) AS DOUBLE) AS y,
       CAST({half_up('length(t) * each + 3')} AS DOUBLE) AS width, 18.0::DOUBLE AS height, 100.0::DOUBLE AS confidence
FROM placed WHERE NOT regexp_matches(t, '[{W}]') AND NOT {noise('t')}"""
    ocr = f"""
WITH o AS (
  SELECT doc_id, CAST(pos AS INTEGER) AS word_index, token AS text, CASE WHEN pos % 50 <> 0 THEN CAST((doc_id * 31 + pos * 17) % 101 AS DOUBLE) END AS confidence,
         pos % 40 * 20.0::DOUBLE AS x, pos // 40 * 22.0::DOUBLE AS y, length(token) * 2.5::DOUBLE AS width, CAST(pos % 9 AS DOUBLE) AS height FROM {tokens()}
), c AS (SELECT *, coalesce(confidence, 0) AS c, text IN (':', '=') AS d FROM o)
SELECT doc_id, word_index, text, x, y, width, height, confidence FROM c
WHERE (regexp_matches(text, '[A-Za-z0-9]') OR d) AND width >= 4 AND height >= 4 AND CASE
  WHEN regexp_full_match(text, '[0-9]{{2,16}}') OR regexp_matches(text, '[0-9]{{1,2}}[/.-][0-9]{{1,2}}[/.-][0-9]{{2,4}}') THEN c >= 25
  WHEN length(text) <= 2 THEN d OR c >= 50 ELSE c >= 35 END"""
    turns = f"""
WITH b AS {BOXES}
SELECT doc_id, word_index, 1 AS turns, 1000 - (y + height) AS x, x AS y, height AS width, width AS height FROM b
UNION ALL SELECT doc_id, word_index, 4, 800 - (800 - x - width + width), 1000 - (1000 - y - height + height), width, height FROM b"""
    tiles = " UNION ALL ".join(
        f"SELECT p_partkey, {n} AS n, r AS row, c AS col, CAST(ceil(img_w / {n} * 1.25) AS BIGINT) AS tile_w, CAST(ceil(img_h / {n} * 1.25) AS BIGINT) AS tile_h, "
        f"CAST({half_up(f'c * (img_w - ceil(img_w / {n} * 1.25)) / {n - 1}')} AS BIGINT) AS offset_x, CAST({half_up(f'r * (img_h - ceil(img_h / {n} * 1.25)) / {n - 1}')} AS BIGINT) AS offset_y "
        f"FROM (SELECT p_partkey, p_size * 13 + 150 AS img_w, p_partkey % 900 + 150 AS img_h FROM part), (SELECT CAST(unnest(generate_series(0, {n - 1})) AS INTEGER) AS r), (SELECT CAST(unnest(generate_series(0, {n - 1})) AS INTEGER) AS c) WHERE img_w >= {least} AND img_h >= {least}"
        for n, least in ((2, 200), (3, 400))
    )
    hit = """
WITH t AS (SELECT event_id AS tap_id, user_id % 50 AS doc_id, event_id * 7 % 500 AS px, event_id * 3 % 60 AS py FROM events),
b AS (
  SELECT d AS doc_id, i, i * 45.0 + d AS x, i % 2 * 20.0 AS y, CASE WHEN i < 2 THEN 0 WHEN i < 4 THEN 1 ELSE 2 END AS o, CASE WHEN i < 4 THEN 4 ELSE 5 END AS m
  FROM (SELECT unnest(generate_series(0, 49)) AS d), (SELECT unnest(generate_series(0, 8)) AS i) WHERE i >= 2 OR (i + d) % 2 = 0
)
SELECT tap_id, CASE o WHEN 0 THEN 'face' WHEN 1 THEN 'manual' ELSE 'word' END AS kind, CAST(i AS INTEGER) AS box_index FROM (
  SELECT tap_id, o, i, row_number() OVER (PARTITION BY tap_id ORDER BY o, CASE WHEN o = 2 THEN sqrt(pow(px - (x + 25), 2) + pow(py - (y + 11), 2)) ELSE 0 END, i DESC) AS k
  FROM t JOIN b USING (doc_id) WHERE px BETWEEN x - m AND x + 50 + m AND py BETWEEN y - m AND y + 22 + m) WHERE k = 1"""
    align = f"""
WITH w AS {BOXES}, r AS (SELECT o_orderkey AS doc_id, 200.0 AS rx, CAST(o_orderkey % 40 AS DOUBLE) AS ry, 60.0 AS rw, 20.0 AS rh FROM orders),
m AS (SELECT r.doc_id, avg(w.height) AS mh, avg(w.y) AS my FROM r JOIN w ON w.doc_id = r.doc_id AND abs(w.y - ry) < 50 AND (abs(w.x - (rx + rw)) < 80 OR abs(rx - (w.x + w.width)) < 80) GROUP BY r.doc_id),
s AS (SELECT r.*, i AS word_index, 12.0 + i * 14 AS h FROM r, (SELECT unnest([0, 1]) AS i))
SELECT s.doc_id, CAST(word_index AS INTEGER) AS word_index, 'w' || word_index AS text, CAST(rx + word_index * 25 AS DOUBLE) AS x, round(CASE WHEN h / mh BETWEEN 0.65 AND 1.35 THEN my ELSE ry + 2 END, 6) AS y, 20.0::DOUBLE AS width,
       round(CASE WHEN h / mh BETWEEN 0.65 AND 1.35 THEN mh ELSE h END, 6)::DOUBLE AS height FROM s LEFT JOIN m ON s.doc_id = m.doc_id"""
    paged = f"""
WITH w AS (SELECT doc_id // 4 AS doc_id, CAST(doc_id % 4 + 1 AS INTEGER) AS page_index, x, y, width, height FROM {BOXES}),
r AS (SELECT o_orderkey // 4 AS doc_id, CAST(o_orderkey % 4 + 1 AS INTEGER) AS page_index, 200.0 AS rx, CAST(o_orderkey % 40 AS DOUBLE) AS ry, 60.0 AS rw FROM orders),
m AS (SELECT r.doc_id, r.page_index, avg(w.height) AS mh, avg(w.y) AS my FROM r JOIN w ON w.doc_id = r.doc_id AND w.page_index = r.page_index AND abs(w.y - ry) < 50 AND (abs(w.x - (rx + rw)) < 80 OR abs(rx - (w.x + w.width)) < 80) GROUP BY ALL),
s AS (
  SELECT r.*, i AS word_index, ['alpha', '-', '2020'][i + 1] AS text, 12.0 + i * 7 AS h FROM r, (SELECT unnest([0, 2]) AS i)
  WHERE CASE WHEN i = 2 THEN true ELSE doc_id % 100 >= 35 END),
a AS (
  SELECT s.doc_id, s.page_index, CAST(word_index AS INTEGER) AS word_index, text, CAST(rx + word_index * 25 AS DOUBLE) AS x, round(CASE WHEN h / mh BETWEEN 0.65 AND 1.35 THEN my ELSE ry + 2 END, 6) AS y,
         20.0::DOUBLE AS width, round(CASE WHEN h / mh BETWEEN 0.65 AND 1.35 THEN mh ELSE h END, 6)::DOUBLE AS height FROM s LEFT JOIN m ON s.doc_id = m.doc_id AND s.page_index = m.page_index)"""
    rescan = f"""{paged}
SELECT doc_id, page_index, text, x, y, width, height FROM a WHERE NOT EXISTS (
  SELECT 1 FROM w WHERE w.doc_id = a.doc_id AND w.page_index = a.page_index
  AND greatest(0, least(a.x + a.width, w.x + w.width) - greatest(a.x, w.x)) * greatest(0, least(a.y + a.height, w.y + w.height) - greatest(a.y, w.y)) > a.width * a.height * 0.5)"""
    dedupe = f"""
WITH e AS {BOXES}, f AS (SELECT doc_id, word_index, x + word_index * 7 AS x, y + doc_id % 13 AS y, width, height FROM e)
SELECT * FROM f WHERE NOT EXISTS (
  SELECT 1 FROM e WHERE e.doc_id = f.doc_id AND greatest(0, least(f.x + f.width, e.x + e.width) - greatest(f.x, e.x)) * greatest(0, least(f.y + f.height, e.y + e.height) - greatest(f.y, e.y)) > f.width * f.height * 0.5)"""
    scrubbed = f"""
WITH RECURSIVE s AS (
  SELECT doc_id, token, row_number() OVER (PARTITION BY doc_id ORDER BY length(token) DESC, min(pos)) AS k
  FROM (SELECT doc_id, pos, token FROM {tokens()} WHERE len({cats('token')}) > 0) GROUP BY doc_id, token
),
f AS (
  SELECT doc_id, text, 0 AS k FROM documents
  UNION ALL SELECT f.doc_id, replace(f.text, s.token, repeat(' ', length(s.token))), f.k + 1 FROM f JOIN s ON f.doc_id = s.doc_id AND s.k = f.k + 1
)
SELECT doc_id, text FROM f QUALIFY k = max(k) OVER (PARTITION BY doc_id)"""
    pdf = lambda x, y, w, h, m: {
        "pdf_x": f"greatest(0, {x} / 1.5 - {m})",
        "pdf_y": f"greatest(0, 842 - ({y} + {h}) / 1.5 - {m})",
        "pdf_w": f"least(595 - {x} / 1.5 + 2, {w} / 1.5 + 2)" if m else f"{w} / 1.5",
        "pdf_h": f"least(842 - (842 - ({y} + {h}) / 1.5) + 2, {h} / 1.5 + 2)" if m else f"{h} / 1.5",
    }
    qualities = ", ".join(f"('{sink}', '{preset}', {q}::DOUBLE)" for sink, values in QUALITY.items() for preset, q in zip(("max", "compact", "optimal"), values, strict=True))
    pool = [*COLOURS, "#1E3A8A", "#123456", ""]
    colour = f"[{', '.join(repr(x) for x in pool)}][p_partkey % {len(pool)} + 1]"
    names = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in COLOURS.items())
    scores = FACE_SCORES
    pad = lambda c, n: f"lpad(CAST({c} AS VARCHAR), {n}, '0')"
    nik = pad("o_orderkey * 7919 + 3171000000000000", 16)
    mark = "['', '-', '.', '/'][o_orderkey % 4 + 1]"
    page = "CASE WHEN l_linenumber > 2 THEN l_linenumber ELSE 1 END"
    hexed = "lower(printf('%06x', p_partkey * 7919 % 16777216))"
    return {
        "pii_category_report": f"WITH {DOCUMENT_CATEGORIES} SELECT {ORD} AS ord, category, {LABEL} AS label, CAST(count(*) AS BIGINT) AS n_words, count(DISTINCT doc_id) AS n_docs FROM found GROUP BY category",
        "pii_document_report": f"WITH {DOCUMENT_CATEGORIES} SELECT doc_id, {ORD} AS ord, category, {LABEL} AS label, count(*) AS n_words, string_agg(word_index, ',' ORDER BY word_index) AS word_indices FROM found GROUP BY doc_id, category",
        "pii_tokens": f"SELECT doc_id, CAST(pos AS INTEGER) AS pos, token, unnest({cats('token')}) AS category FROM {tokens()}",
        "pii_by_lang_source": f"SELECT lang, source, category, count(*) AS n_tokens, count(DISTINCT doc_id) AS n_docs FROM (SELECT doc_id, unnest({cats('token')}) AS category FROM {tokens()}) JOIN documents USING (doc_id) GROUP BY lang, source, category",
        "pii_pages": f"SELECT page_id, category, count(*) AS n FROM (SELECT page_id, unnest({cats('token')}) AS category FROM {tokens('pages', 'page_id', 'html')}) GROUP BY ALL",
        "token_forms": f"SELECT {fuzzy('token')} AS fuzzy, {clean('token')} AS clean, {noise('token')} AS noise, count(*) AS n FROM {tokens()} GROUP BY ALL",
        "custom_keyword": f"SELECT doc_id, count(*) AS n, CAST(min(pos) AS INTEGER) AS first_pos FROM {tokens()} WHERE contains(lower(token), 'erth') GROUP BY doc_id",
        "synthetic_phone": synthetic("customer", "c_custkey", f"CASE c_custkey % 3 WHEN 0 THEN '08' || {pad('c_custkey', 9)} WHEN 1 THEN '+628' || {pad('c_custkey', 9)} ELSE '021-5' || substr({pad('c_custkey', 9)}, 4, 6) END"),
        "synthetic_nik": synthetic("orders", "o_orderkey", f"substr({nik}, 1, 4) || {mark} || substr({nik}, 5, 4) || {mark} || substr({nik}, 9, 4) || {mark} || substr({nik}, 13, 4)"),
        "synthetic_bpjs": synthetic("customer", "c_custkey", f"'000' || {pad('c_custkey', 10)}"),
        "synthetic_npwp": synthetic("customer", "c_custkey", f"'01.' || {pad('c_custkey % 1000', 3)} || '.345.6-012.' || {pad('c_custkey % 997', 3)}"),
        "synthetic_id": synthetic("part", "p_partkey", f"CASE WHEN p_partkey % 2 = 0 THEN 'A' ELSE 'al' END || {pad('p_partkey', 7)}"),
        "synthetic_dob": synthetic("orders", "o_orderkey", "CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE CAST(day(o_orderdate) AS VARCHAR) || strftime(o_orderdate, '/%b/%Y') END"),
        "synthetic_ttl": synthetic("(SELECT * FROM orders JOIN region ON o_orderkey % 5 = r_regionkey)", "o_orderkey", "r_name || ',' || strftime(o_orderdate, '%d-%m-%Y')"),
        "synthetic_email": synthetic("supplier", "s_suppkey", "'info' || s_suppkey || '@Example.co.id'"),
        "synthetic_ocr_noise": synthetic("customer", "c_custkey", f"translate('08' || {pad('c_custkey', 9)}, '0158', 'OISB')"),
        "multi_token_date": f"WITH {DATE_WORDS} SELECT dn.doc_id, CAST(dn.word_index AS INTEGER) AS word_index, text FROM dn JOIN dm ON dn.doc_id = dm.doc_id AND dn.word_index = dm.word_index",
        "contextual_indices": f"WITH {DATE_WORDS} SELECT dn.doc_id, string_agg(CAST(dn.word_index AS VARCHAR), ',' ORDER BY dn.word_index) AS word_indices FROM dn LEFT JOIN dm ON dn.doc_id = dm.doc_id AND dn.word_index = dm.word_index WHERE dm.doc_id IS NOT NULL OR {hits('date', 'text')} OR {hits('nik', 'text')} OR contains(lower(text), 'on') GROUP BY dn.doc_id",
        "label_proximity": f"WITH b AS {BOXES}, l AS (SELECT * FROM b WHERE word_index IN (1, 3, 5)) SELECT b.doc_id, b.word_index, l.word_index AS label_index, CASE WHEN abs(b.y - l.y) <= 11 THEN 'right' ELSE 'below' END AS side FROM b JOIN l ON b.doc_id = l.doc_id AND b.word_index <> l.word_index WHERE (abs(b.y - l.y) <= 11 AND b.x - l.x - l.width BETWEEN 0 AND 70) OR (b.y - l.y > 11 AND b.y - l.y <= 44 AND b.x < l.x + l.width AND b.x + b.width > l.x)",
        "word_geometry": word_places,
        "text_item_bounds": f"SELECT l_orderkey, l_linenumber, {round6(vx='l_tax * 1.5', vy='(842 - l_quantity * 8) * 1.5', font_height='fh', top='(842 - l_quantity * 8) * 1.5 - fh * 0.82', line_height='fh * 1.08', item_width='l_quantity * 1.5')} FROM (SELECT *, greatest((l_linenumber + 3) * 1.5::DOUBLE, sqrt(l_quantity * l_quantity + l_linenumber * l_linenumber * 2.25::DOUBLE) * 1.5, 10) AS fh FROM lineitem)",
        "pixel_to_point": f"SELECT l_orderkey, l_linenumber, {round6(**pdf('(l_quantity * 17)', 'l_quantity * 25', '(l_linenumber * 30.0::DOUBLE)', '18.0::DOUBLE', 1))} FROM lineitem",
        "ocr_word_filter": ocr,
        "region_neighbour_align": align,
        "region_neighbour_pages": f"{paged} SELECT * FROM a",
        "region_rescan": rescan,
        "region_scan_dedupe": dedupe,
        "ocr_blocks": "WITH t AS (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS text, unnest(generate_series(0, len(string_split(p_name, ' ')) - 1)) AS i, (len(string_split(p_name, ' ')) + 1) // 2 AS evens FROM part), o AS (SELECT p_partkey AS doc_id, 1 AS page_index, CAST(CASE WHEN i % 2 = 0 THEN i // 2 ELSE evens + i // 2 END AS INTEGER) AS word_index, text, i * 50.0::DOUBLE AS x, 0.0::DOUBLE AS y, length(text) * 3.0::DOUBLE AS width, 10.0::DOUBLE AS height, CAST(20 + (p_partkey * 7 + i * 13) % 80 AS DOUBLE) AS confidence FROM t) SELECT * FROM o WHERE regexp_matches(text, '[A-Za-z0-9]') AND width >= 4 AND CASE WHEN regexp_full_match(text, '[0-9]{2,16}') THEN confidence >= 25 WHEN length(text) <= 2 THEN confidence >= 50 ELSE confidence >= 35 END",
        "unicode_space_dates": f"WITH t AS (SELECT o_orderkey AS doc_id, CAST(o_orderkey AS VARCHAR) AS token FROM orders) SELECT doc_id, 'dob' AS category, 3::BIGINT AS n_words, '1,2,3' AS word_indices FROM t UNION ALL SELECT doc_id, unnest({cats('token')}), 1, '4' FROM t",
        "detected_faces": f"SELECT k.page AS page_index, k.cand_index AS region_index, 'face' AS kind, {round6(x='px', y='py', w='least(1000 - px, w * 1.16)', h='least(1000 - py, h * 1.18)')} FROM ({_nms()}) k JOIN (SELECT *, greatest(0, x - w * 0.08) AS px, greatest(0, y - h * 0.12) AS py FROM {CANDIDATES}) c ON k.page = c.page AND k.cand_index = c.cand_index",
        "checked_categories": f"SELECT c_custkey, 'dob,bank' AS checked, {hits('nik', 'token')} OR {hits('dob', 'token')} OR {hits('bank', 'token')} AS hidden FROM (SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN '08' || {pad('c_custkey', 9)} WHEN 1 THEN 'A' || {pad('c_custkey', 7)} ELSE '3171' || {pad('c_custkey', 12)} END AS token FROM customer)",
        "manual_cleared": f"WITH {AUTO} SELECT ow.doc_id, ow.word_index, CASE WHEN action = 'redact' AND dn.doc_id IS NOT NULL THEN 'unredact' ELSE action END AS action FROM ow LEFT JOIN dn ON ow.doc_id = dn.doc_id AND ow.word_index = dn.word_index",
        "face_toggles": f"SELECT doc_id, page_index, region_index FROM {REGIONS} WHERE region_index % 3 <> 0 AND region_index % 11 <> 0 AND (region_index % 7 = 0) = (region_index % 2 = 0)",
        "redacted_word_ranking": f"WITH {AUTO}, g AS (SELECT doc_id, text, count(*) AS n, CAST(min(word_index) AS INTEGER) AS first_index FROM de WHERE redacted OR auto GROUP BY doc_id, text) SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first_index) AS INTEGER) AS rank FROM g",
        "export_report": f"WITH {AUTO}, w AS (SELECT doc_id, count(DISTINCT page) AS n_pages, count(*) AS n_words, count(*) FILTER (redacted) AS n_redacted, coalesce(string_agg(text, ' ' ORDER BY word_index) FILTER (redacted), '') AS redacted_words FROM de GROUP BY doc_id), r AS (SELECT doc_id, count(*) FILTER (kind = 'face') AS n_faces, count(*) FILTER (kind = 'manual') AS n_manual FROM {ACTIVE} GROUP BY doc_id) SELECT w.doc_id, n_pages, n_words, n_redacted, coalesce(n_faces, 0) AS n_faces, coalesce(n_manual, 0) AS n_manual, CASE WHEN w.doc_id % 2 = 0 THEN 'image' ELSE 'text-pdf' END AS document_type, 'Red' AS colour, redacted_words FROM w LEFT JOIN r ON w.doc_id = r.doc_id",
        "exported_files": "WITH d AS (SELECT p_partkey AS doc_id, CASE WHEN p_partkey % 5 <> 0 THEN p_name ELSE '' END AS base, ['text-pdf', 'image-pdf', 'image'][p_partkey % 3 + 1] AS document_type, p_partkey % 4 % 3 + 1 AS n_pages FROM part) SELECT doc_id, document_type, CASE WHEN base <> '' THEN regexp_replace(base, '[/\\?%*:|\"<>]', '_', 'g') WHEN document_type <> 'image' THEN 'redacted-pdf' WHEN n_pages > 1 THEN 'redacted-images' ELSE 'redacted-image' END || CASE WHEN document_type = 'image' AND n_pages = 1 THEN '.png' ELSE '.pdf' END AS filename, n_pages, n_pages AS pages_in_file FROM d",
        "rotate_boxes": turns,
        "face_tiles": tiles,
        "face_candidates_filter": f"SELECT page, cand_index FROM {CANDIDATES} WHERE {PLAUSIBLE}",
        "face_nms": _nms(),
        "face_padding": f"SELECT page, cand_index, {round6(x='px', y='py', w='least(1000 - px, w * 1.16)', h='least(1000 - py, h * 1.18)')} FROM (SELECT *, greatest(0, x - w * 0.08) AS px, greatest(0, y - h * 0.12) AS py FROM {CANDIDATES})",
        "face_scores": f"SELECT vec_id AS cand_index, CASE WHEN vec_id % 4 >= 2 THEN 0.75::DOUBLE ELSE CAST(CASE vec_id % 3 WHEN 0 THEN {scores[0]} WHEN 1 THEN {scores[1]} ELSE {scores[2]} END AS DOUBLE) END AS score FROM embeddings",
        "hit_test": hit,
        "selection_rect": "WITH d AS (SELECT event_id, (event_id % 200 - 10) / 2 AS x1, (event_id * 3 % 160 - 10) / 2 AS y1, (event_id * 7 % 220 - 10) / 2 AS x2, (event_id * 5 % 180 - 10) / 2 AS y2 FROM events) SELECT event_id, least(x1, x2) AS x, least(y1, y2) AS y, abs(x2 - x1) AS w, abs(y2 - y1) AS h FROM d WHERE abs(x2 - x1) >= 12 AND abs(y2 - y1) >= 12",
        "clamped_dimensions": f"SELECT p_partkey, CAST({half_up('w * r')} AS INTEGER) AS width, CAST({half_up('h * r')} AS INTEGER) AS height FROM (SELECT *, least(1.0::DOUBLE, 2400.0::DOUBLE / greatest(w, h)) AS r FROM (SELECT p_partkey, p_size * 100.0::DOUBLE AS w, p_partkey % 5000 + 100.0::DOUBLE AS h FROM part))",
        "filled_rects": f"SELECT doc_id, word_index, {round6(x='x * 0.9', y='y * 0.9', width='width * 0.9', height='height * 0.9')} FROM {BOXES}",
        "effective_redaction_reference": f"WITH {AUTO} SELECT doc_id, CAST(word_index AS INTEGER) AS word_index, auto, redacted, redacted OR auto AS effective FROM de",
        "effective_redaction_honour": f"WITH {AUTO} SELECT doc_id, CAST(word_index AS INTEGER) AS word_index, auto, redacted, redacted AS effective FROM de",
        "toggled_words": f"WITH {AUTO}, tg AS (SELECT (event_id % 1000) + 1 AS doc_id, CAST(user_id % 5 AS INTEGER) AS word_index FROM events GROUP BY 1, 2 HAVING count(*) % 2 = 1) SELECT tg.doc_id, tg.word_index, CASE WHEN coalesce(auto, false) THEN 'unredact' ELSE 'redact' END AS action FROM tg LEFT JOIN au ON tg.doc_id = au.doc_id AND tg.word_index = au.word_index",
        "manual_word_groups": f"WITH {AUTO}, mw AS (SELECT dn.* FROM dn JOIN ow ON dn.doc_id = ow.doc_id AND dn.word_index = ow.word_index WHERE action = 'redact') SELECT doc_id, text, count(*) AS n, string_agg(CAST(word_index AS VARCHAR), ',' ORDER BY word_index) AS word_indices, (SELECT string_agg(CAST(p AS VARCHAR), ',' ORDER BY p) FROM (SELECT unnest(list_distinct(list(page))) AS p)) AS pages FROM mw GROUP BY doc_id, text",
        "indexed_words": f"SELECT doc_id, CAST(CASE WHEN turn = 0 THEN 1 ELSE turn END AS INTEGER) AS page_index, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY turn, p) - 1 AS INTEGER) AS word_index, text FROM (SELECT conv_id AS doc_id, turn, unnest(regexp_split_to_array(text, '{WS}')) AS text, generate_subscripts(regexp_split_to_array(text, '{WS}'), 1) AS p FROM conversations) WHERE text <> ''",
        "active_regions": f"SELECT * FROM {ACTIVE}",
        "removed_pages": f"WITH r AS {REGIONS} SELECT doc_id, page_index, region_index FROM r WHERE (doc_id, page_index) NOT IN (SELECT (doc_id, page_index) FROM r WHERE region_index % 7 = 0)",
        "appended_pages": "WITH p AS (SELECT conv_id AS doc_id, CAST(turn AS INTEGER) AS page_pos, CAST(turn AS INTEGER) + 1 AS page_index FROM conversations), l AS (SELECT doc_id, max(page_pos) AS m, max(page_index) AS i FROM p GROUP BY doc_id) SELECT * FROM p UNION ALL SELECT labels.doc_id, coalesce(m + 1, 0), coalesce(i, 0) + 1 FROM labels LEFT JOIN l ON labels.doc_id = l.doc_id",
        "redacted_word_freq": f"WITH {AUTO} SELECT doc_id, text, count(*) AS n, CAST(min(word_index) AS INTEGER) AS first_index FROM de WHERE redacted GROUP BY doc_id, text",
        "export_stats": f"WITH {AUTO}, w AS (SELECT doc_id, count(DISTINCT page) AS n_pages, count(*) AS n_words, count(*) FILTER (redacted) AS n_redacted FROM de GROUP BY doc_id), r AS (SELECT doc_id, count(*) FILTER (kind = 'face') AS n_faces, count(*) FILTER (kind = 'manual') AS n_manual FROM {ACTIVE} GROUP BY doc_id) SELECT w.doc_id, n_pages, n_words, n_redacted, coalesce(n_faces, 0) AS n_faces, coalesce(n_manual, 0) AS n_manual FROM w LEFT JOIN r ON w.doc_id = r.doc_id",
        "page_totals": "SELECT page_id % 100 AS doc_id, CAST(max(CASE WHEN page_id % 3 <> 0 THEN length(url) * 10 ELSE 800 END) AS INTEGER) AS max_width, CAST(sum(CASE WHEN page_id % 4 = 0 THEN 1000 ELSE page_id % 4 * 300 END) + 24 * (count(*) - 1) + 160 AS BIGINT) AS total_height, CAST(sum(strlen(html)) AS BIGINT) AS n_bytes FROM pages GROUP BY 1",
        "scrub_text": scrubbed,
        "redaction_rects": f"SELECT doc_id, 1 AS page_index, 'word' AS kind, {round6(**pdf('x', 'y', 'width', 'height', 1))} FROM {BOXES} WHERE word_index % 2 = 0 UNION ALL SELECT a.doc_id, 1, kind, {round6(**pdf('x', 'y', 'w', 'h', 0))} FROM {ACTIVE} a JOIN orders ON a.doc_id = o_orderkey",
        "inspect_text_dominant": f"WITH {_INSPECT} SELECT * FROM ins",
        "routed_files": f"WITH {_INSPECT} SELECT d.doc_id, CASE WHEN d.doc_id % 4 = 0 THEN 'png' ELSE 'pdf' END AS kind, is_text_dominant, CASE WHEN d.doc_id % 4 = 0 THEN 'image' WHEN coalesce(is_text_dominant, false) THEN 'text-pdf' ELSE 'image-pdf' END AS document_type FROM documents d LEFT JOIN ins ON d.doc_id = ins.doc_id",
        "image_pages": "SELECT batch_id, CAST(n AS INTEGER) AS page_index, name, CASE WHEN c > 1 THEN 'Image ' || n || ' (' || name || ')' ELSE name END AS label, width, height, 0 AS rotation FROM (SELECT page_id % 120 AS batch_id, url AS name, CASE WHEN page_id % 3 = 0 THEN 800 ELSE page_id % 3 * 400 END AS width, CASE WHEN page_id % 5 = 0 THEN 1000 ELSE 700 END AS height, row_number() OVER (PARTITION BY page_id % 120 ORDER BY page_id) AS n, count(*) OVER (PARTITION BY page_id % 120) AS c FROM pages)",
        "assembled_pages": "SELECT o_orderkey AS doc_id, 1 AS page_index, coalesce(string_agg('w' || l_linenumber, ' ' ORDER BY l_linenumber), '') AS text, CAST(count(l_linenumber) AS INTEGER) AS n_words FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY o_orderkey",
        "hex_to_rgb": f"WITH c AS (SELECT p_partkey, {hexed} AS b FROM part), d AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '#' || substr(b, 1, 3) WHEN 1 THEN 'zz' ELSE '#' || b END AS colour, CASE p_partkey % 5 WHEN 0 THEN substr(b, 1, 1) || substr(b, 1, 1) || substr(b, 2, 1) || substr(b, 2, 1) || substr(b, 3, 1) || substr(b, 3, 1) WHEN 1 THEN '000000' ELSE b END AS f FROM c) SELECT p_partkey, colour, {round6(**{c: f'CAST((chr(48) || chr(120) || substr(f, {2 * i + 1}, 2)) AS INTEGER) / 255' for i, c in enumerate('rgb')})} FROM d",
        "format_bytes": f"SELECT k AS o_orderkey, {_bytes_label('n')} AS label FROM (SELECT k, {_BYTES} AS n FROM (SELECT o_orderkey AS k FROM orders))",
        "clean_filename": f"SELECT page_id, {_file_name(2)} AS filename, {_file_name(1, '.zip')} AS archive FROM ({_FILE})",
        "colour_names": f"SELECT p_partkey, CASE lower({colour}) {names} WHEN '' THEN 'Black' ELSE {colour} END AS colour FROM part",
        "savings": f"SELECT o_orderkey, CASE WHEN a > 0 AND b < a THEN CAST({half_up('(1 - b / a) * 100')} AS BIGINT) END AS percent FROM (SELECT o_orderkey, CAST(o_orderkey % 50 * 10 AS DOUBLE) AS a, CAST(o_orderkey % 37 * 11 AS DOUBLE) AS b FROM orders)",
        "labels_and_ids": f"SELECT l_orderkey, l_linenumber, 'face-' || {page} || '-' || l_orderkey AS face_id, 'pdf-page-' || {page} AS page_id, 'Page ' || {page} AS label FROM lineitem",
        "zip_entries": "SELECT doc_id % 40 AS archive, doc_id, 'redacted-' || doc_id || '.txt' AS name, strlen(coalesce(text, '')) AS n_bytes, CAST(coalesce(sum(30 + length('redacted-' || doc_id || '.txt') + strlen(coalesce(text, ''))) OVER (PARTITION BY doc_id % 40 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM documents",
        "page_boxes_mm": f"SELECT p_partkey, {round6(width_mm='w / 1.8 / 72 * 25.4', height_mm='h / 1.8 / 72 * 25.4')}, CASE WHEN w > h THEN 'landscape' ELSE 'portrait' END AS orientation FROM (SELECT p_partkey, p_size * 40.0::DOUBLE AS w, p_partkey % 1500 + 200.0::DOUBLE AS h FROM part)",
        "export_qualities": f"SELECT * FROM (VALUES {qualities}) AS t(sink, preset, quality)",
    }
