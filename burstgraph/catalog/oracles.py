"""The catalog's queries as plain SQL over the same tables."""

from burstgraph.catalog.queries import EVENT, LEVEL, MIN_COUNT, MIN_WEIGHT, N, PAIR_WEIGHT, RATE
from burstgraph.functions.hashing import mixed_sql, uniform_sql
from burstgraph.functions.timeaxis import NAMED_WINDOWS
from burstgraph.operators.distributions import BASE, COMMUNITY_BINS, DEGREE_BINS, TOP
from burstgraph.operators.memory import MUTE_DIVISORS
from burstgraph.operators.nullmodel import QUADRANTS
from burstgraph.operators.smoothing import savgol_coefficients
from burstgraph.sources.sinks import GEXF_CLOSE, GEXF_MIDDLE, GEXF_OPEN
from burstgraph.sources.tables import EVENT_ORIGIN, SHIP_ORIGIN, USER_HOURS

MONTH = "CAST((year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 AS INTEGER)"


def month(column: str) -> str:
    return MONTH.replace("l_shipdate", column)


def hours(column: str, origin: str) -> str:
    return f"CAST(floor((epoch({column}) - epoch(TIMESTAMP '{origin}')) / 3600) AS INTEGER)"


SIGNAL = f"""signal AS (SELECT l_partkey AS id, {MONTH} AS hour, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)"""
USERS = f"""users AS (SELECT user_id AS id, {hours('ts', EVENT_ORIGIN)} AS hour, sum(value) AS value
  FROM events GROUP BY 1, 2 HAVING sum(value) <> 0)"""
EDGES = """ends AS (SELECT l_orderkey, min(l_partkey) AS low, max(l_partkey) AS high FROM lineitem GROUP BY 1),
edges AS (SELECT low AS src, l_partkey AS dst FROM lineitem JOIN ends USING (l_orderkey) WHERE low < l_partkey
  UNION SELECT l_partkey, high FROM lineitem JOIN ends USING (l_orderkey) WHERE l_partkey < high)"""
STATS = f"""stats AS (SELECT id, mean, sd, {RATE} * sd + mean AS threshold FROM (
  SELECT id, sum(value) / {N} AS mean,
    sqrt(greatest(sum(value * value) / {N} - (sum(value) / {N}) * (sum(value) / {N}), 0.0)) AS sd
  FROM signal GROUP BY id))"""
BURSTS = f"""peaks AS (SELECT s.* FROM signal s JOIN stats USING (id) WHERE value > threshold),
bursts AS (SELECT * FROM peaks WHERE id IN (
  SELECT id FROM peaks WHERE hour > 0 AND hour < {N} GROUP BY id HAVING count(*) > {MIN_COUNT}))"""


def weigh(name: str, source: str, edges: str, start: int, stop: int, floor=0.0, normalise=True, lam=0.5, keep=None) -> str:
    """CTEs that give edge weights; ``keep`` prunes and drops unweighted edges.

    Without ``keep`` all links are weighed, from arrays with one place per hour: a join row per link, none per link and hour.
    """
    value = "value / n" if normalise else "value"
    series = f"""{name}_k AS (SELECT * FROM {source} WHERE hour > {start} AND hour < {stop} AND value > {floor}),
{name}_x AS (SELECT id, hour, {value} AS v FROM {name}_k JOIN (SELECT id, count(*) AS n FROM {name}_k GROUP BY id) USING (id)),"""
    if keep is None:
        return f"""{series}
{packed(name, name + "_x", start, stop)},
{name} AS (SELECT src, dst, {ratios(lam, "0.0")} AS weight
  FROM {edges} e LEFT JOIN {name}_d a ON a.id = e.src LEFT JOIN {name}_d b ON b.id = e.dst)"""
    return f"""{series}
{name}_j AS MATERIALIZED (SELECT e.src, e.dst, a.hour, a.v FROM {edges} e JOIN {name}_x a ON a.id = e.src),
{name}_s AS (SELECT a.src, a.dst, sum(CASE WHEN least(a.v, b.v) / greatest(a.v, b.v) > {lam}
    THEN least(a.v, b.v) / greatest(a.v, b.v) ELSE 0 END) AS w
  FROM {name}_j a JOIN {name}_x b ON b.id = a.dst AND a.hour = b.hour GROUP BY 1, 2),
{name} AS (SELECT src, dst, w AS weight FROM {edges} JOIN {name}_s USING (src, dst) WHERE w > {keep})"""


def packed(name: str, samples: str, start: int, stop: int) -> str:
    """CTE ``<name>_d``: (id, vs), the values v of each id as a list with a place for every hour of the open window."""
    return f"""{name}_d AS MATERIALIZED (SELECT id, list(v ORDER BY hour) AS vs FROM (
  SELECT i.id, h.hour, x.v FROM (SELECT DISTINCT id FROM {samples}) i CROSS JOIN (SELECT unnest(range({start} + 1, {stop})) AS hour) h
  LEFT JOIN {samples} x ON x.id = i.id AND x.hour = h.hour) GROUP BY id)"""


def ratios(lam: float, otherwise: str) -> str:
    """Sum over the common hours of lists a.vs and b.vs: the ratio where it exceeds ``lam``, else ``otherwise``."""
    ratio = "least(p[1], p[2]) / greatest(p[1], p[2])"
    terms = f"[CASE WHEN {ratio} > {lam} THEN {ratio} ELSE {otherwise} END FOR p IN list_zip(a.vs, b.vs) IF p[1] IS NOT NULL AND p[2] IS NOT NULL]"
    return f"coalesce(list_sum({terms}), 0.0)"


def components(name: str, edges: str) -> str:
    """CTEs that label every vertex an edge touches with its component's smallest id."""
    return f"""{name}_e AS (SELECT src AS a, dst AS b FROM {edges} UNION SELECT dst, src FROM {edges}),
{name}_r AS (SELECT DISTINCT a AS id, a AS c FROM {name}_e UNION
  SELECT e.b, r.c FROM {name}_r r JOIN {name}_e e ON e.a = r.id WHERE r.c < e.b),
{name} AS (SELECT id, min(c) AS component FROM {name}_r GROUP BY id)"""


def nth(name: str, labels: str, n: int) -> str:
    return f"""{name} AS (SELECT id FROM {labels} WHERE component = (
  SELECT component FROM {labels} GROUP BY 1 ORDER BY count(*) DESC, component LIMIT 1 OFFSET {n}))"""


def learned(min_weight: float = MIN_WEIGHT) -> list[str]:
    return [SIGNAL, EDGES, STATS, BURSTS, weigh("w", "bursts", "edges", 0, N, keep=min_weight)]


ALL_WEIGHTS = [SIGNAL, EDGES, weigh("w", "signal", "edges", -1, N)]
MATRIX = """m AS (SELECT src, dst, sum(weight) AS weight FROM (
  SELECT src, dst, weight FROM w UNION ALL SELECT dst, src, weight FROM w) GROUP BY 1, 2)"""
CELLS = """cells AS (SELECT s.id, s.hour FROM signal s JOIN stats t ON t.id = s.id WHERE s.value > 2.0 * t.sd + t.mean)"""
TOTALS = "totals AS (SELECT src AS id, sum(CAST(weight AS DECIMAL(28, 12))) AS total FROM m GROUP BY 1)"
ROWS = "rows_ AS (SELECT DISTINCT id FROM signal)"
MEMORY = [*learned(), MATRIX, CELLS, TOTALS, ROWS]
CLUSTER = "cluster AS (SELECT p_partkey AS id FROM part WHERE p_brand IN ('Brand#3', 'Brand#4', 'Brand#5'))"


def scores(name: str, cells: str, by: str = "") -> str:
    by = f"{by}, " if by else ""
    return f"""{name} AS (SELECT {by}id, hour, 2 * a - total AS score FROM (
  SELECT {by}src AS id, hour, sum(CAST(weight AS DECIMAL(28, 12))) AS a FROM m JOIN {cells} c ON c.id = m.dst GROUP BY ALL) JOIN totals USING (id))"""


def recalled(name: str, cells: str, tie: int = 1, by: str = "") -> str:
    test = ">= 0" if tie > 0 else "> 0"
    columns = f"{by}, id, hour" if by else "id, hour"
    return f"{scores(name + '_s', cells, by)}, {name} AS (SELECT {columns} FROM {name}_s WHERE score {test})"


def select(parts: list[str], final: str, recursive: bool = False) -> str:
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + final


def component_rows(nodes: str, links: str, titles: str = "SELECT p_partkey AS id, p_name AS title FROM part") -> str:
    return f"""SELECT 'vertex' AS kind, id AS src, id AS dst, 0.0::DOUBLE AS weight, title
  FROM {nodes} LEFT JOIN ({titles}) USING (id)
UNION ALL SELECT 'edge', src, dst, round(weight, 6), '' FROM {links}"""


def smoothed(source: str, window: int, key: str = "") -> list[str]:
    """CTEs from ``source`` (key, hour, value; dense) to ``source_sm``."""
    half = window // 2
    k = f"{key}, " if key else ""
    on = f"USING ({key})" if key else "ON true"
    rows = ", ".join(f"({i}, {c!r}::DOUBLE)" for i, c in enumerate(savgol_coefficients(window, 2)))
    last = N - 1
    return [
        f"{source}_c(k, c) AS (VALUES {rows})",
        f"""{source}_e AS (SELECT {k}max(CASE WHEN hour = 0 THEN value END) AS f,
  max(CASE WHEN hour = {last} THEN value END) AS l FROM {source} {'GROUP BY ' + key if key else ''})""",
        f"""{source}_p AS (SELECT {k}hour, value FROM {source}
  UNION ALL SELECT {k}-hour, f - abs(value - f) FROM {source} JOIN {source}_e {on} WHERE hour BETWEEN 1 AND {half}
  UNION ALL SELECT {k}{2 * last} - hour, l + abs(value - l) FROM {source} JOIN {source}_e {on}
    WHERE hour BETWEEN {last - half} AND {last - 1})""",
        f"""{source}_sm AS (SELECT {k}CAST(hour - k + {half} AS INTEGER) AS hour, sum(value * c) AS value
  FROM {source}_p, {source}_c WHERE hour - k + {half} BETWEEN 0 AND {last} GROUP BY ALL)""",
    ]


def dense(name: str, source: str, value: str = "value") -> str:
    return f"""{name} AS (SELECT CAST(h AS INTEGER) AS hour, coalesce({value}, 0)::DOUBLE AS value
  FROM range({N}) t(h) LEFT JOIN {source} s ON s.hour = t.h)"""


def curve_difference(window: int) -> list[str]:
    """CTEs from cells and back (both id, hour) to the difference of their smoothed activities."""
    parts = []
    for name, cells in (("oc", "cells"), ("rc", "back")):
        parts += [
            f"{name}_a AS (SELECT hour, 2 * count(*) AS value FROM {cells} GROUP BY 1)",
            dense(name, f"{name}_a"),
            *smoothed(name, window),
            f"{name}_z AS (SELECT hour, value - (SELECT min(value) FROM {name}_sm) AS value FROM {name}_sm)",
        ]
    return parts


DIFFERENCE = """SELECT hour, round(a.value, 6) + 0.0::DOUBLE AS original, round(b.value, 6) + 0.0::DOUBLE AS recalled,
  round(b.value - a.value, 6) + 0.0::DOUBLE AS difference FROM oc_z a JOIN rc_z b USING (hour)"""


def muted(name: str, divisors: tuple[float, ...]) -> str:
    rows = ", ".join(f"({d}::DOUBLE)" for d in divisors)
    return f"""{name}_o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS o FROM cluster),
{name}_d(divisor) AS (VALUES {rows}),
{name} AS (SELECT divisor, c.id, c.hour FROM cells c LEFT JOIN {name}_o USING (id), {name}_d
  WHERE o IS NULL OR o >= floor((SELECT count(*) FROM cluster) / divisor))"""


def rates(rows: str, original: str, back: str, hours_: int, by: str = "", values: str = "") -> str:
    """Error rates from cell tables; one row per value of ``by``."""
    selected = f"{by}, " if by else ""
    pair = f"b.{by} = v.{by} AND " if by else ""
    source = values or "(SELECT 1)"
    return f"""o AS (SELECT * FROM {original} WHERE id IN (SELECT id FROM {rows})),
b AS (SELECT * FROM {back} WHERE id IN (SELECT id FROM {rows})),
lone AS (SELECT id FROM {rows} WHERE id NOT IN (SELECT src FROM m)),
sums AS (SELECT {selected}(SELECT count(*) FROM o) AS no,
  (SELECT count(*) FROM b WHERE {pair}true) AS nb,
  (SELECT count(*) FROM b JOIN o USING (id, hour) WHERE {pair}true) AS hits,
  (SELECT count(*) FROM lone) * {hours_} - (SELECT count(*) FROM o WHERE id IN (SELECT id FROM lone)) AS lost
  FROM {source} v)
SELECT {selected}round(1 - hits / no, 6) + 0.0::DOUBLE AS miss_rate,
  round((no + nb - 2 * hits + lost) / ((SELECT count(*) FROM {rows}) * {hours_}), 6) + 0.0::DOUBLE AS mismatch_rate FROM sums"""


CLEAN_VERTICES = """clean AS (SELECT p_partkey AS id, replace(p_name || '&' || p_brand, '&', '') AS title FROM part
  WHERE p_brand <> 'Brand#2' AND p_type <> 'SMALL' AND p_partkey IN (SELECT id FROM signal))"""
DOUBLED = "doubled AS (SELECT src AS id, weight FROM w UNION ALL SELECT dst, weight FROM w)"


def histogram(values: str, bins: int, count: str) -> str:
    return f"""edges_(k, lo, hi) AS (SELECT k, pow({BASE}, {TOP} * k / {bins}), pow({BASE}, {TOP} * (k + 1) / {bins}) FROM range({bins + 1}) t(k)),
h AS (SELECT k AS bin, lo AS lower, count(v) AS n FROM edges_ LEFT JOIN {values} s
  ON CASE WHEN k = {bins} THEN v > lo WHEN k = {bins - 1} THEN v BETWEEN lo AND hi ELSE v >= lo AND v < hi END GROUP BY 1, 2)
SELECT CAST(bin AS INTEGER) AS bin, round(lower, 6) + 0.0::DOUBLE AS lower, {count} AS count FROM h"""


def gexf_text(lines: tuple[str, ...]) -> str:
    return ", ".join("('" + line.replace("'", "''") + "')" for line in lines)


def gexf(vertices: str, edges: str, weight: str | None) -> str:
    fixed = " UNION ALL ".join(
        f"SELECT {section} AS section, line FROM (VALUES {gexf_text(lines)}) t(line)"
        for section, lines in ((0, GEXF_OPEN), (2, GEXF_MIDDLE), (4, GEXF_CLOSE))
    )
    escaped = "replace(replace(replace(replace(title, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;')"
    label = f"CAST({weight or 'weight'} AS VARCHAR)"
    extra = "" if weight is None else f" || '\" weight=\"' || {label}"
    return f"""{fixed}
UNION ALL SELECT 1, '      <node id="' || id || '" label="' || {escaped} || '" />' FROM {vertices}
UNION ALL SELECT 3, '        <edge source="' || src || '" target="' || dst || '" label="' || {label}{extra} || '" />' FROM {edges}"""


LCC = [components("cc", "w"), nth("lcc", "cc", 0)]
LCC_EDGES = "(SELECT * FROM w WHERE src IN (SELECT id FROM lcc))"
COARSE = [
    *learned(),
    "strong AS (SELECT * FROM w WHERE weight > 1.5)",
    components("cc", "strong"),
    "lab AS (SELECT p_partkey AS id, p_name AS title, coalesce(component, p_partkey) AS c FROM part LEFT JOIN cc ON cc.id = p_partkey)",
]
HOPS = [
    *learned(0.5),
    """reach AS (SELECT min(src) AS id, 0 AS distance FROM w UNION
  SELECT w.dst, distance + 1 FROM reach JOIN w ON w.src = reach.id)""",
    "hops AS (SELECT id, CAST(min(distance) AS INTEGER) AS distance FROM reach GROUP BY 1)",
]

_u = uniform_sql([mixed_sql(["src", "dst"], 1), "level + 1"], 1)
_a, _b, _c = QUADRANTS["a"], QUADRANTS["b"], QUADRANTS["c"]
NULL_EDGES = [
    EDGES,
    "size AS (SELECT CAST(count(*) AS BIGINT) AS n, CAST(greatest(1, ceil(log2(greatest(2, 2 * count(*))))) AS INTEGER) AS levels FROM part)",
    f"""walk AS (SELECT src, dst, 0 AS level, 0::BIGINT AS s, 0::BIGINT AS t FROM edges UNION ALL
  SELECT src, dst, level + 1, s * 2 + CASE WHEN u >= {_a + _b} THEN 1 ELSE 0 END,
    t * 2 + CASE WHEN (u >= {_a} AND u < {_a + _b}) OR u >= {_a + _b + _c} THEN 1 ELSE 0 END
  FROM (SELECT *, {_u} AS u FROM walk WHERE level < (SELECT levels FROM size)))""",
    """drawn AS (SELECT DISTINCT s - h AS src, t - h AS dst FROM walk,
  (SELECT CAST(pow(2, levels - 1) AS BIGINT) AS h, n, levels FROM size)
  WHERE level = levels AND s <> t AND s >= h AND s - h < n AND t >= h AND t - h < n)""",
]
NUMBERED = """numbered AS (SELECT p_partkey AS old, p_name AS title, row_number() OVER (ORDER BY p_partkey) - 1 AS id FROM part),
renamed AS (SELECT n.id, s.hour, s.value FROM signal s JOIN numbered n ON n.old = s.id)"""

PAIRS = f"""found AS (SELECT a.id AS src, b.id AS dst, sum(CASE WHEN least(a.value, b.value) / greatest(a.value, b.value) > 0.5
    THEN least(a.value, b.value) / greatest(a.value, b.value) ELSE 0 END) AS weight
  FROM %s a JOIN %s b ON a.hour = b.hour AND a.id < b.id GROUP BY 1, 2 HAVING weight > {PAIR_WEIGHT})"""

WIDE_WINDOWS = ", ".join(f"('{name}', {a}, {b})" for name, (a, b) in NAMED_WINDOWS.items())
DIVISOR_ROWS = ", ".join(f"({d}::DOUBLE)" for d in MUTE_DIVISORS)
CELL_HASH = uniform_sql(["id", "hour"], 7)
NOISE_HASH = uniform_sql(["id", "hour"], 3)
GRID = f"grid AS (SELECT id, CAST(h AS INTEGER) AS hour FROM rows_, range({N}) t(h))"

ORACLES: dict[str, str] = {
    # sources and sinks
    "signal_long": f"SELECT l_partkey AS id, {MONTH} AS hour, max(l_quantity) AS value FROM lineitem GROUP BY 1, 2 HAVING max(l_quantity) <> 0",
    "signal_wide": select([SIGNAL], "SELECT id, CAST(hour + 1 AS INTEGER) AS hour, value FROM signal"),
    "vertices": select([SIGNAL, CLEAN_VERTICES], "SELECT id, title FROM clean"),
    "edges_base": select(
        [SIGNAL, EDGES, CLEAN_VERTICES],
        "SELECT src, dst, 0.0::DOUBLE AS weight FROM edges WHERE src IN (SELECT id FROM clean) AND dst IN (SELECT id FROM clean)",
    ),
    "labels": "SELECT p_partkey AS id, p_brand AS label FROM part",
    "edges_weighted": select(ALL_WEIGHTS, "SELECT src, dst, round(weight, 6) + 0.0::DOUBLE AS weight FROM w"),
    "saved_roundtrip": select([SIGNAL], "SELECT id, hour, value FROM signal"),
    "signal_text_roundtrip": select(
        [SIGNAL], "SELECT id, hour, value, layout FROM signal, (VALUES ('lines'), ('concatenated')) t(layout)"
    ),
    "pagecounts_filter": """SELECT lang, 'page_' || doc_id AS name, n_chars AS count, n_chars * 2 AS size
FROM documents WHERE lang = 'en' AND n_chars > 100""",
    "gexf_lines": select(
        [*learned(), *LCC, "nodes AS (SELECT id, p_name AS title FROM lcc JOIN part ON p_partkey = id)", f"links AS (SELECT src, dst, round(weight, 6) + 0.0::DOUBLE AS weight FROM {LCC_EDGES})"],
        gexf("nodes", "links", "weight"),
        True,
    ),
    "gexf_file": select(
        [EDGES, "nodes AS (SELECT p_partkey AS id, p_brand AS title FROM part)", "links AS (SELECT src, dst, 0.0::DOUBLE AS weight FROM edges)"],
        f"SELECT line FROM ({gexf('nodes', 'links', None)})",
    ),
    "edges_export": select(
        learned(), "SELECT src, dst, p_name AS src_title, round(weight, 6) + 0.0::DOUBLE AS weight FROM w JOIN part ON p_partkey = src"
    ),
    "weights_export": select(ALL_WEIGHTS, "SELECT round(weight, 6) + 0.0::DOUBLE AS weight FROM w WHERE weight > 0"),
    # projections and filters
    "title_clean": r"""SELECT doc_id, md5(replace(replace(text, '&', ''), '\"', '')) AS stored,
  md5(replace(replace(text, '&', ' '), '\n', '')) AS exported,
  md5(regexp_replace(text, '[^\x20-\x7E\t\n\r\x0B\x0C]', '', 'g')) AS printable,
  md5(replace(text, '_', ' ')) AS display FROM documents""",
    "window_slice": select([SIGNAL], "SELECT * FROM signal WHERE hour > 20 AND hour < 60"),
    "active_in_window": select(
        [SIGNAL], "SELECT * FROM signal WHERE id IN (SELECT id FROM signal WHERE hour > 20 AND hour < 22)"
    ),
    "peak_above": select(
        [SIGNAL],
        f"SELECT * FROM signal WHERE id IN (SELECT id FROM signal WHERE hour > 0 AND hour < {N} GROUP BY id HAVING max(value) > 100)",
    ),
    "activity_band": select(
        [SIGNAL], "SELECT * FROM signal WHERE id IN (SELECT id FROM signal GROUP BY id HAVING count(*) > 20 AND count(*) < 28)"
    ),
    "prune_edges": select(ALL_WEIGHTS, "SELECT src, dst, round(weight, 6) + 0.0::DOUBLE AS weight FROM w WHERE weight > 3.0"),
    "select_by_title": """SELECT p_partkey AS id, p_name AS label FROM part
WHERE p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#1')""",
    "titles_present": """SELECT count(DISTINCT p_name) AS listed,
  count(DISTINCT p_name) FILTER (p_name IN (SELECT p_name FROM part WHERE p_brand = 'Brand#2')) AS present
FROM part WHERE p_brand = 'Brand#1'""",
    "drop_positions": f"""SELECT id, c_name FROM (SELECT c_custkey AS id, c_name, row_number() OVER (ORDER BY c_custkey) - 1 AS position FROM customer)
WHERE position NOT IN (SELECT {month('o_orderdate')} FROM orders)""",
    "memory_matrix": select(
        [*learned(1.2), MATRIX], "SELECT src, dst, round(weight, 6) + 0.0::DOUBLE AS weight FROM m"
    ),
    "memory_matrix_cluster": select(
        [*learned(), CLUSTER],
        """SELECT src, dst, sum(1.0)::DOUBLE AS weight FROM (
  SELECT src, dst FROM w WHERE src IN (SELECT id FROM cluster) AND dst IN (SELECT id FROM cluster)
  UNION ALL SELECT dst, src FROM w WHERE src IN (SELECT id FROM cluster) AND dst IN (SELECT id FROM cluster)) GROUP BY 1, 2""",
    ),
    "map_filter_window": select([SIGNAL], "SELECT * FROM signal WHERE hour > 20 AND hour < 60"),
    # joins
    "all_pairs": select([USERS, PAIRS % ("users", "users")], "SELECT src, dst, round(weight, 6) + 0.0::DOUBLE AS weight FROM found"),
    "hebb_weights": select(ALL_WEIGHTS, "SELECT src, dst, round(weight, 6) + 0.0::DOUBLE AS weight FROM w"),
    "hebb_weights_floor": select(
        [SIGNAL, EDGES, weigh("w", "signal", "edges", 10, 70, floor=20.0, normalise=False, lam=0.7)],
        "SELECT src, dst, round(weight, 6) + 0.0::DOUBLE AS weight FROM w",
    ),
    "labelled_graph": select(
        learned(),
        r"""SELECT p_partkey AS id, replace(replace(p_name, '&', ' '), '\n', '') AS title FROM part
WHERE p_partkey IN (SELECT src FROM w UNION SELECT dst FROM w)""",
    ),
    # aggregations
    "ordinal_ids": "SELECT c_custkey AS id, row_number() OVER (ORDER BY c_custkey) - 1 AS ordinal FROM customer",
    "series_stats": select(
        [SIGNAL, STATS], "SELECT id, round(mean, 6) + 0.0::DOUBLE AS mean, round(sd, 6) + 0.0::DOUBLE AS sd, round(threshold, 6) + 0.0::DOUBLE AS threshold FROM stats"
    ),
    "burst_vertices": select([SIGNAL, STATS, BURSTS], "SELECT id, hour, value FROM bursts"),
    "component_sizes": select(
        [*learned(2.0), components("cc", "w")], "SELECT component, count(*) AS size FROM cc GROUP BY 1", True
    ),
    "overall_activity": select([USERS], "SELECT hour, round(sum(value), 6) + 0.0::DOUBLE AS value FROM users GROUP BY 1"),
    "daily_activity": select(
        [USERS, "d AS (SELECT CAST(floor(hour / 24) AS INTEGER) AS day, sum(value) AS v FROM users GROUP BY 1)"],
        "SELECT day, round(v * 100.0 / (SELECT max(v) FROM d), 6) + 0.0::DOUBLE AS value FROM d",
    ),
    "degrees": select(
        [*learned(), DOUBLED],
        "SELECT id, count(*) AS degree, round(sum(weight), 6) + 0.0::DOUBLE AS weighted_degree FROM doubled GROUP BY 1",
    ),
    "stage_counts": select(
        [*learned(), *LCC],
        f"""SELECT 'base' AS stage, (SELECT count(*) FROM part) AS vertices, (SELECT count(*) FROM edges) AS edges, 0::BIGINT AS positive_edges
UNION ALL SELECT 'pruned', (SELECT count(DISTINCT id) FROM bursts), count(*), count(*) FROM w
UNION ALL SELECT 'without_singletons', (SELECT count(*) FROM cc), count(*), count(*) FROM w
UNION ALL SELECT 'component', (SELECT count(*) FROM lcc), count(*), count(*) FROM {LCC_EDGES}""",
        True,
    ),
    # time series
    "signed_similarity": select(
        [SIGNAL, EDGES, "f AS (SELECT id, count(*) AS n FROM signal GROUP BY 1)", "x AS (SELECT id, hour, value / n AS v FROM signal JOIN f USING (id))",
         packed("x", "x", -1, N)],
        f"""SELECT src, dst, round({ratios(0.5, "-least(p[1], p[2]) / greatest(p[1], p[2])")}, 6) + 0.0::DOUBLE AS weight
FROM edges LEFT JOIN x_d a ON a.id = src LEFT JOIN x_d b ON b.id = dst""",
    ),
    "chunked_pearson": select(
        [SIGNAL, EDGES,
         "j AS MATERIALIZED (SELECT src, dst, hour, value FROM edges JOIN signal ON id = src)",
         f"""c AS (SELECT src, dst, a.value AS x, b.value AS y, row_number() OVER (PARTITION BY src, dst ORDER BY a.hour) AS rn,
    count(*) OVER (PARTITION BY src, dst) AS n
  FROM j a JOIN signal b ON b.id = dst AND a.hour = b.hour WHERE a.hour > -1 AND a.hour < {N})""",
         """k AS (SELECT src, dst, (rn - 1) // 24 AS chunk, max(n) AS n, sum(x) AS x, sum(y) AS y, sum(x * x) AS xx, sum(y * y) AS yy, sum(x * y) AS xy
  FROM c GROUP BY 1, 2, 3)""",
         "d AS (SELECT *, sqrt(greatest(xx - x * x / n, 0) * greatest(yy - y * y / n, 0)) AS den FROM k)",
         "s AS (SELECT src, dst, sum(CASE WHEN den = 0 THEN 0 ELSE (xy - x * y / n) / den END) AS w FROM d GROUP BY 1, 2)"],
        "SELECT src, dst, round(coalesce(w, 0), 6) + 0.0::DOUBLE AS weight FROM edges LEFT JOIN s USING (src, dst)",
    ),
    "smoothed_activity": select(
        [SIGNAL, "act AS (SELECT hour, sum(value) AS value FROM signal GROUP BY 1)", dense("d", "act"), *smoothed("d", 5)],
        "SELECT hour, round(value, 6) + 0.0::DOUBLE AS value FROM d_sm",
    ),
    "smoothed_by_label": select(
        [SIGNAL,
         f"""d AS (SELECT label, CAST(h AS INTEGER) AS hour, coalesce(v, 0)::DOUBLE AS value
  FROM (SELECT DISTINCT p_brand AS label FROM part JOIN signal ON id = p_partkey) CROSS JOIN range({N}) t(h)
  LEFT JOIN (SELECT p_brand AS label, hour AS h, sum(value) AS v FROM signal JOIN part ON p_partkey = id GROUP BY 1, 2) USING (label, h))""",
         *smoothed("d", 25, "label")],
        "SELECT label, hour, round(value, 6) + 0.0::DOUBLE AS value FROM d_sm",
    ),
    "recall_difference": select([*MEMORY, recalled("back", "cells"), *curve_difference(5)], DIFFERENCE),
    "hourly_expand": f"""SELECT CAST({month('o_orderdate')} * 24 + h AS INTEGER) AS hour, round(sum(o_totalprice), 6) + 0.0::DOUBLE AS value
FROM orders, range(24) t(h) GROUP BY 1""",
    "named_windows": f"""WITH s AS (SELECT l_partkey AS id, {hours('l_shipdate', SHIP_ORIGIN)} AS hour, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_quantity) <> 0)
SELECT w AS "window", count(*) AS samples, count(DISTINCT id) AS ids, round(sum(value), 6) + 0.0::DOUBLE AS value
FROM s JOIN (VALUES {WIDE_WINDOWS}) t(w, a, b) ON hour > a AND hour < b GROUP BY 1""",
    "calendar_marks": select(
        [USERS],
        f"""SELECT hour, CAST(hour(moment) = 0 AND day(moment) = 1 AS INTEGER) AS month_start, CAST(hour(moment) = 0 AND isodow(moment) = 1 AS INTEGER) AS monday,
  CAST(hour(moment) = 0 AND isodow(moment) = 6 AS INTEGER) AS saturday
FROM (SELECT DISTINCT hour, TIMESTAMP '{EVENT_ORIGIN}' + to_hours(hour) AS moment FROM users)""",
    ),
    # graph
    "remove_singletons": select(
        learned(), "SELECT p_partkey AS id, p_name AS title FROM part WHERE p_partkey IN (SELECT src FROM w UNION SELECT dst FROM w)"
    ),
    "connected_components": select(
        [*learned(), components("cc", "w")],
        "SELECT p_partkey AS id, coalesce(component, p_partkey) AS component FROM part LEFT JOIN cc ON cc.id = p_partkey",
        True,
    ),
    "nth_component": select(
        [*learned(2.0), components("cc", "w"), nth("lcc", "cc", 1)], component_rows("lcc", LCC_EDGES), True
    ),
    "coarsen": select(COARSE, "SELECT c AS id, min(title) AS title, count(*) AS members FROM lab GROUP BY 1", True),
    "coarsen_edges": select(
        COARSE,
        """SELECT a.c AS src, b.c AS dst, round(weight, 6) + 0.0::DOUBLE AS weight FROM w JOIN lab a ON a.id = w.src JOIN lab b ON b.id = w.dst
WHERE NOT weight > 1.5""",
        True,
    ),
    "hop_distances": select(HOPS, "SELECT id, distance FROM hops", True),
    "hop_summary": select(
        HOPS,
        "SELECT count(*) AS reached, round(avg(distance), 6) + 0.0::DOUBLE AS mean_distance, max(distance) AS max_distance FROM hops WHERE distance > 0",
        True,
    ),
    "null_model_edges": select(NULL_EDGES, "SELECT src, dst FROM drawn", True),
    "component_full_signals": select(
        [*learned(), *LCC,
         """base AS (SELECT * FROM edges WHERE src IN (SELECT id FROM lcc) AND dst IN (SELECT id FROM lcc))""",
         "deg AS (SELECT id, count(*) AS base_degree FROM (SELECT src AS id FROM base UNION ALL SELECT dst FROM base) GROUP BY 1)"],
        "SELECT s.id, hour, value, base_degree FROM signal s JOIN lcc USING (id) LEFT JOIN deg USING (id)",
        True,
    ),
    # associative memory
    "binarise": select([SIGNAL], "SELECT id, hour FROM signal WHERE value > 40"),
    "binarise_sigma": select([SIGNAL, STATS, CELLS], "SELECT id, hour FROM cells"),
    "degrade": select(
        [SIGNAL, STATS, CELLS, ROWS, GRID],
        f"""SELECT id, hour FROM (SELECT g.id, g.hour, c.id IS NOT NULL AS lit FROM grid g LEFT JOIN cells c ON c.id = g.id AND c.hour = g.hour)
WHERE lit <> ({CELL_HASH} < 0.2)""",
    ),
    "mute": select([SIGNAL, STATS, CELLS, CLUSTER, muted("mu", (1.5,))], "SELECT id, hour FROM mu"),
    "recall_step": select([*MEMORY, recalled("back", "cells")], "SELECT id, hour FROM back"),
    "recall_scores": select([*MEMORY, scores("sc", "cells")], "SELECT id, hour, round(score, 6) + 0.0::DOUBLE AS score FROM sc"),
    "recall_steps": select(
        [*MEMORY, recalled("b1", "cells", -1), recalled("b2", "b1", -1), recalled("b3", "b2", -1)], "SELECT id, hour FROM b3"
    ),
    "recall_random": select(
        [*MEMORY, GRID, f"noise AS (SELECT id, hour FROM grid WHERE {NOISE_HASH} < 0.5)", recalled("back", "noise")],
        "SELECT id, hour FROM back",
    ),
    "recall_error": select([*MEMORY, recalled("back", "cells")], ", " + rates("rows_", "cells", "back", N)),
    "recall_error_event": select(
        [*MEMORY, recalled("all_back", "cells"),
         f"ev AS (SELECT * FROM cells WHERE hour >= {EVENT[0]} AND hour < {EVENT[1]})",
         f"""back AS (SELECT id, CAST(h AS INTEGER) AS hour FROM (SELECT DISTINCT id FROM all_back WHERE hour >= {EVENT[0]} AND hour < {EVENT[1]}),
  range({EVENT[0]}, {EVENT[1]}) t(h))"""],
        ", " + rates("rows_", "ev", "back", EVENT[1] - EVENT[0]),
    ),
    # jobs
    "learn_peaks": select([*learned(), *LCC], component_rows("lcc", LCC_EDGES), True),
    "learn_static": select(
        [SIGNAL, EDGES, weigh("w", "signal", "edges", -1, N, keep=7.0), *LCC], component_rows("lcc", LCC_EDGES), True
    ),
    "learn_all_pairs": select(
        [USERS,
         f"loud AS (SELECT * FROM users WHERE id IN (SELECT id FROM users WHERE hour > -1 AND hour < {USER_HOURS} GROUP BY id HAVING max(value) > {LEVEL}))",
         PAIRS % ("loud", "loud"), "nodes AS (SELECT src AS id FROM found UNION SELECT dst FROM found)"],
        component_rows("nodes", "found", "SELECT c_custkey AS id, c_name AS title FROM customer"),
    ),
    "learn_null_model": select(
        [SIGNAL, *NULL_EDGES, NUMBERED, weigh("w", "renamed", "drawn", -1, N, keep=5.0), *LCC],
        component_rows("lcc", LCC_EDGES, "SELECT id, title FROM numbered"),
        True,
    ),
    "recall_experiment": select(
        [*MEMORY, CLUSTER, muted("mu", (3.0,)), recalled("back", "mu"), *curve_difference(7)], DIFFERENCE
    ),
}

_COMPARED = f"""WITH a AS (SELECT {MONTH} AS day, sum(l_quantity) AS v FROM lineitem GROUP BY 1),
p AS (SELECT day, v * 100.0 / (SELECT max(v) FROM a) AS proposed FROM a),
r AS (SELECT {month('o_orderdate')} AS day, sum(o_totalprice) AS reference FROM orders GROUP BY 1)
"""
_POINTS = [*learned(0.0), DOUBLED, "pts AS (SELECT x, count(*) AS y FROM (SELECT id, count(*) AS x FROM doubled GROUP BY 1) GROUP BY 1)"]
_SERIES = f"""FROM (SELECT DISTINCT id FROM signal) i CROSS JOIN (SELECT CAST(h AS INTEGER) AS hour FROM range({N}) t(h)) LEFT JOIN signal s USING (id, hour)"""
_DEGREES = "deg AS (SELECT id, count(*) AS v FROM (SELECT src AS id FROM edges UNION ALL SELECT dst FROM edges) GROUP BY 1)"

ORACLES.update(
    {
        "reference_compare": _COMPARED + "SELECT day, round(proposed, 6) + 0.0::DOUBLE AS proposed, round(reference, 6) + 0.0::DOUBLE AS reference FROM p JOIN r USING (day)",
        "reference_corr": _COMPARED + "SELECT round(corr(proposed, reference), 6) + 0.0::DOUBLE AS correlation FROM p JOIN r USING (day)",
        "powerlaw_alpha": select(
            _POINTS, "SELECT round(max(y)::DOUBLE, 6) + 0.0::DOUBLE AS c, round(1 + count(*) / sum(ln(x / (SELECT min(x) FROM pts))), 6) + 0.0::DOUBLE AS alpha FROM pts"
        ),
        "powerlaw_slope": select(
            _POINTS, "SELECT round(regr_slope(ln(y), ln(x)), 6) + 0.0::DOUBLE AS slope, round(regr_intercept(ln(y), ln(x)), 6) + 0.0::DOUBLE AS intercept FROM pts"
        ),
        "degree_histogram": select(
            [EDGES, _DEGREES], ", " + histogram("deg", DEGREE_BINS, "round(n / (SELECT max(n) FROM h), 6)")
        ),
        "community_sizes": select(
            ["sz AS (SELECT p_brand, count(*) AS v FROM part GROUP BY 1)"], ", " + histogram("sz", COMMUNITY_BINS, "n")
        ),
        "series_arrays": select(
            [SIGNAL],
            f"SELECT id, {N} AS length, string_agg(CAST(CAST(coalesce(value, 0) AS BIGINT) AS VARCHAR), ',' ORDER BY hour) AS series {_SERIES} GROUP BY id",
        ),
        "cluster_signals": select(
            [SIGNAL],
            f"""SELECT '(' || id || ',[' || string_agg(CAST(coalesce(value, 0.0::DOUBLE) AS VARCHAR), ',' ORDER BY hour) || '])' AS value
{_SERIES} WHERE id IN (SELECT p_partkey FROM part WHERE p_brand = 'Brand#7') GROUP BY id""",
        ),
        "mute_sweep": select(
            [*MEMORY, "cluster AS (SELECT src AS id FROM w UNION SELECT dst FROM w)", muted("mu", MUTE_DIVISORS), recalled("back", "mu", -1, by="divisor")],
            ", sweep AS (WITH "
            + rates("cluster", "cells", "back", N, "divisor", f"(SELECT * FROM (VALUES {DIVISOR_ROWS}) t(divisor))")
            + ") SELECT CAST(floor(100.0 / divisor) AS INTEGER) AS percent, miss_rate, mismatch_rate FROM sweep",
        ),
        "mute_sweep_event": select(
            [*MEMORY, "cluster AS (SELECT src AS id FROM w UNION SELECT dst FROM w)", muted("mu", MUTE_DIVISORS), recalled("all_back", "mu", -1, by="divisor"),
             f"ev AS (SELECT * FROM cells WHERE hour >= {EVENT[0]} AND hour < {EVENT[1]})",
             f"""back AS (SELECT divisor, id, CAST(h AS INTEGER) AS hour FROM (SELECT DISTINCT divisor, id FROM all_back
  WHERE hour >= {EVENT[0]} AND hour < {EVENT[1]}), range({EVENT[0]}, {EVENT[1]}) t(h))"""],
            ", sweep AS (WITH "
            + rates("cluster", "ev", "back", EVENT[1] - EVENT[0], "divisor", f"(SELECT * FROM (VALUES {DIVISOR_ROWS}) t(divisor))")
            + ") SELECT CAST(floor(100.0 / divisor) AS INTEGER) AS percent, miss_rate, mismatch_rate FROM sweep",
        ),
    }
)
