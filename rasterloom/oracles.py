"""Each registered query as one DuckDB statement, written independently of the Spark plans."""

from __future__ import annotations

ZEROS = "'000000000000'"

EVENTS = """SELECT CAST(event_id // 1000 AS BIGINT) AS image_id, CAST(0 AS INTEGER) AS c, CAST((event_id % 1000) // 40 AS INTEGER) AS y,
    CAST(event_id % 40 AS INTEGER) AS x, CAST(least(255, floor(value)) AS INTEGER) AS sample FROM events"""
EMBEDDINGS = """SELECT CAST(vec_id // 20 AS BIGINT) AS image_id, CAST(0 AS INTEGER) AS c, CAST(vec_id % 20 AS INTEGER) AS y,
    CAST(i - 1 AS INTEGER) AS x, CAST(floor((CAST(embedding[i] AS DOUBLE) + 1) * 127.5) AS INTEGER) AS sample
    FROM embeddings, (SELECT unnest(range(1, 65)) AS i)"""
PIXELS = """SELECT CAST(o_orderkey // 1500 AS BIGINT) AS image_id, CAST((o_orderkey % 1500) // 50 AS INTEGER) AS y, CAST(o_orderkey % 50 AS INTEGER) AS x,
    CAST(least(255, floor(o_totalprice / 2000)) AS INTEGER) AS raw0, CAST(least(255, coalesce(q, 0)) AS INTEGER) AS raw1,
    CAST(least(255, 15 * coalesce(n, 0)) AS INTEGER) AS raw2
    FROM orders LEFT JOIN (SELECT l_orderkey, sum(l_quantity) AS q, count(*) AS n FROM lineitem GROUP BY l_orderkey) ON l_orderkey = o_orderkey"""


def _long(pixels: str, prefix: str, value: str) -> str:
    return " UNION ALL ".join(f"SELECT image_id, CAST({k} AS INTEGER) AS c, y, x, {prefix}{k} AS {value} FROM ({pixels})" for k in range(3))


ORDERS = _long(PIXELS, "raw", "sample")
STEP = "CAST((x | y) & -(x | y) AS INTEGER)"


def _with(ctes: list[tuple[str, str]], last: str) -> str:
    return "WITH " + ",\n".join(f"{n} AS ({q})" for n, q in ctes) + "\n" + last


def _guess(kind: str, update: bool, step: int) -> str:
    near = f"lag(v, {step}) OVER w"
    right = f"coalesce(lead(v, {step}) OVER w, {near})"
    if kind == "linear":
        return f"(({near} + {right}) // {4 if update else 2})"
    far_left = f"coalesce(lag(v, {3 * step}) OVER w, {near})"
    far_right = f"coalesce(lead(v, {3 * step}) OVER w, {right})"
    wide = f"(9 * ({near} + {right}) - {far_left} - {far_right})"
    tap = f"(({wide} + CASE WHEN {wide} < 0 THEN -8 ELSE 8 END) // 16)"
    middle = f"list_sort([{near}, {right}, {tap}])[2]"
    return f"({middle} // 2)" if update else f"({middle})"


def _lifting(ctes: list, kind: str, w: int, h: int, levels: int | None = None, inverse: bool = False) -> None:
    """Appends one CTE for each pass; the last one's name ends the list."""
    steps, s = [], 1
    while (s < w or s < h) and (levels is None or len(steps) < levels):
        steps.append(s)
        s *= 2
    passes = []
    for s in steps:
        for size, along, across in ((w, "x", "y"), (h, "y", "x")):
            if s < size:
                passes += [(s, along, across, False), (s, along, across, True)]
    for s, along, across, update in reversed(passes) if inverse else passes:
        sign = "+" if update != inverse else "-"
        first = 0 if update else s
        new = f"CASE WHEN {across} % {s} = 0 AND {along} % {2 * s} = {first} AND {along} > 0 THEN v {sign} {_guess(kind, update, s)} ELSE v END"
        query = f"SELECT image_id, c, y, x, CAST({new} AS INTEGER) AS v FROM {ctes[-1][0]} WINDOW w AS (PARTITION BY image_id, c, {across} ORDER BY {along})"
        ctes.append((f"p{len(ctes)}", query))


def _quality(q: str, high: int) -> str:
    return f"greatest(1, least({high}, CAST({STEP} AS BIGINT) * {q}))"


def _quantised(ctes: list, q: str, high: int, side: int, back: bool = False) -> None:
    factor = _quality(q, high)
    new = f"(CAST(v AS BIGINT) * {high} + sign(v) * {high // 2}) // {factor}" if back else f"(CAST(v AS BIGINT) * {factor}) // {high}"
    on = f"{STEP} > 0 AND {STEP} < {side} AND {factor} < {high}"
    ctes.append((f"p{len(ctes)}", f"SELECT image_id, c, y, x, CAST(CASE WHEN {on} THEN {new} ELSE v END AS INTEGER) AS v FROM {ctes[-1][0]}"))


def _boost(raster: str, boost: int = 1) -> list:
    return [("p0", f"SELECT image_id, c, y, x, CAST(sample * {boost} AS INTEGER) AS v FROM ({raster})")]


def _select(ctes: list, columns: str = "image_id, c, y, x, v") -> str:
    return _with(ctes, f"SELECT {columns} FROM {ctes[-1][0]}")


def _events_coded() -> list:
    ctes = _boost(EVENTS, 8)
    _lifting(ctes, "linear", 40, 25)
    _quantised(ctes, "124", 8192, 25)
    return ctes


def unsigned(x: str, pot: int, depth: int = 4) -> str:
    own = f"repeat('0', CAST({x} >> {pot} AS INTEGER)) || '1'"
    if pot:
        own += f" || right('{'0' * pot}' || bin({x} & {(1 << pot) - 1}), {pot})"
    if not depth:
        return f"({own})"
    bound = 12 << pot
    return f"(CASE WHEN {x} < {bound} THEN {own} ELSE {ZEROS} || {unsigned(f'({x} - {bound})', min(pot + 4, 24), depth - 1)} END)"


def interleaved(x: str, pot: int) -> str:
    return unsigned(f"(CASE WHEN {x} > 0 THEN 2 * {x} - 1 ELSE -2 * {x} END)", pot)


def signed(x: str, pot: int) -> str:
    return f"({unsigned(f'abs({x})', pot)} || CASE WHEN {x} > 0 THEN '1' WHEN {x} < 0 THEN '0' ELSE '' END)"


BITS_HEX = """array_to_string(list_transform(range((length(bits) + 31) // 32), lambda k: array_to_string(list_transform([3, 2, 1, 0],
    lambda b: printf('%02X', CAST(list_sum(list_transform(range(8), lambda i: CASE WHEN substr(bits, 32 * k + 8 * b + i + 1, 1) = '1'
    THEN 128 >> i ELSE 0 END)) AS INTEGER))), '')), '')"""


def _blocked(source: str, top: int, shift: int) -> str:
    """Cells with their level and block; the origin joins the top level."""
    return f"""SELECT *, y // side AS block_y, x // side AS block_x FROM (SELECT *, CAST(level_step << {shift} AS INTEGER) AS side FROM
        (SELECT *, CASE WHEN (x | y) = 0 THEN {top} ELSE {STEP} END AS level_step FROM {source}))"""


BLOCK = "image_id, level_step, c, block_y, block_x"


def _turbo(ctes: list) -> list:
    """Bits of every block of the coded events; only the finest level has runs at this quality (124 * step < 2048: up to step 16)."""
    ctes.append(("cells", _blocked(ctes[-1][0], 32, 3)))
    ctes.append(("placed", f"SELECT *, row_number() OVER (PARTITION BY {BLOCK} ORDER BY y, x) AS n FROM cells WHERE (x | y) > 0"))
    run = f"n - coalesce(lag(n) OVER (PARTITION BY {BLOCK} ORDER BY y, x), 0) - 1"
    ctes.append(("hits", f"SELECT *, CAST({run} AS INTEGER) AS run FROM placed WHERE v <> 0"))
    ctes.append(("ends", f"SELECT {BLOCK}, max(n) AS n FROM placed GROUP BY ALL"))
    ctes.append(("lasts", f"SELECT {BLOCK}, max(n) AS n FROM hits GROUP BY ALL"))
    with_runs = "level_step * 124 < 2048"
    moved = "(CASE WHEN v < 0 THEN v + 1 ELSE v END)"
    ctes.append(
        (
            "pieces",
            f"""SELECT {BLOCK}, -1 AS y, -1 AS x, '' AS code FROM (SELECT DISTINCT image_id, c, y // s AS block_y, x // s AS block_x, s // 8 AS level_step
                FROM p0, (SELECT unnest([8, 16, 32, 64, 128, 256]) AS s))
            UNION ALL SELECT {BLOCK}, y, x, {signed('v', 4)} FROM cells WHERE (x | y) = 0
            UNION ALL SELECT {BLOCK}, y, x, {unsigned('run', 1)} || {interleaved(moved, 1)} FROM hits WHERE {with_runs}
            UNION ALL SELECT {BLOCK}, y, x, {interleaved('v', 1)} FROM placed WHERE NOT {with_runs}
            UNION ALL SELECT {BLOCK}, 1000, 1000, {unsigned('CAST(ends.n - coalesce(lasts.n, 0) AS INTEGER)', 1)} FROM ends LEFT JOIN lasts USING ({BLOCK})
                WHERE {with_runs} AND ends.n > coalesce(lasts.n, 0)""",
        )
    )
    ctes.append(("texts", f"SELECT {BLOCK}, string_agg(code, '' ORDER BY y, x) AS bits FROM pieces GROUP BY ALL"))
    ctes.append(("words", f"SELECT *, CAST((length(bits) + 31) // 32 AS INTEGER) AS n_words FROM texts"))
    return ctes


LEVELS = """SELECT image_id, level_step, count(*) AS blocks, CAST(4 * sum(n_words) AS BIGINT) AS coded FROM words GROUP BY ALL"""
STARTS = """SELECT *, CAST(coalesce(sum(4 * blocks + coded) OVER (PARTITION BY image_id ORDER BY level_step DESC
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM levels"""


def _offsets() -> str:
    ctes = [*_turbo(_events_coded()), ("levels", LEVELS), ("starts", STARTS)]
    ctes.append(("numbered", "SELECT *, block_y * ((40 + 8 * level_step - 1) // (8 * level_step)) + block_x AS block_index FROM words"))
    at = """start + 4 * blocks + coalesce(sum(4 * n_words) OVER (PARTITION BY image_id, level_step ORDER BY block_index
        ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"""
    return _with(ctes, f"SELECT image_id, level_step, CAST(block_index AS INTEGER) AS block_index, n_words, CAST({at} AS BIGINT) AS at FROM numbered JOIN starts USING (image_id, level_step)")


def _interest() -> str:
    """The walk over levels by recursion, one step a level."""
    ctes = [*_turbo(_events_coded()), ("levels", LEVELS), ("starts", STARTS)]
    walk = """SELECT image_id, prefix, 64 AS level_step, CAST(prefix + 1024 AS BIGINT) AS target, false AS cut, false AS late, false AS stop
            FROM (SELECT DISTINCT image_id FROM levels), (SELECT unnest([3, 40, 100, 200, 400, 100000]) AS prefix)
        UNION ALL SELECT w.image_id, w.prefix, s.level_step,
            CASE WHEN start > prefix OR prefix - start <= 4 * blocks THEN w.target
                 ELSE start + 4 * blocks + coded + CASE WHEN s.level_step > 1 THEN 16 * blocks ELSE 0 END END,
            start > prefix OR prefix - start <= 4 * blocks OR prefix < start + 4 * blocks + coded,
            start > prefix, start > prefix OR prefix - start <= 4 * blocks
            FROM walk w JOIN starts s ON s.image_id = w.image_id AND s.level_step = w.level_step // 2 WHERE NOT w.stop"""
    ends = "SELECT *, row_number() OVER (PARTITION BY image_id, prefix ORDER BY level_step) AS k FROM walk"
    last = f"""SELECT image_id, CAST(CASE WHEN late THEN NULL WHEN cut THEN target ELSE 0 END AS BIGINT) AS point_of_interest,
        CASE WHEN late THEN 'underflow' ELSE 'ok' END AS status, CAST(prefix AS INTEGER) AS prefix FROM ({ends}) WHERE k = 1"""
    return "WITH RECURSIVE " + ",\n".join(f"{n} AS ({q})" for n, q in [*ctes, ("walk", walk)]) + "\n" + last


SPECS = """SELECT o_orderkey AS image_id, 1 AS version, o_orderkey % 4001 AS width, 1 + o_orderkey % 701 AS height, 1 + o_orderkey % 4 AS channels,
    1 + o_orderkey % 3 AS layers, o_orderkey % 1025 AS quality, 1 + o_orderkey % 255 AS chroma_scale, 1 + o_orderkey % 30 AS block_size,
    ['linear', 'cubic'][1 + o_orderkey % 2] AS filter, ['turbo', 'fast', 'contextual'][1 + o_orderkey % 3] AS encoder,
    ['generic', 'rgb', 'rgba', 'bgr', 'bgra', 'yuv444'][1 + o_orderkey % 6] AS intent, 4 * (o_orderkey % 5) AS metadata_size FROM orders"""
GOOD = f"SELECT * FROM ({SPECS}) WHERE width > 0 AND quality > 0 AND block_size > 1"


def _le(value: str, size: int) -> str:
    return " || ".join(f"printf('%02X', CAST(({value}) >> {8 * k} & 255 AS INTEGER))" for k in range(size))


def _header() -> str:
    packed = "(block_size - 2) | ((chroma_scale - 1) << 5) | ((quality - 1) << 13)"
    intent = "CASE intent WHEN 'generic' THEN 0 WHEN 'rgb' THEN 7 WHEN 'rgba' THEN 8 WHEN 'bgr' THEN 10 WHEN 'bgra' THEN 11 ELSE 12 END"
    encoder = "CASE encoder WHEN 'turbo' THEN 0 WHEN 'fast' THEN 1 ELSE 2 END"
    filters = "CASE filter WHEN 'linear' THEN 0 ELSE 1 END"
    parts = ["'4746575801000000'", _le("width", 4), _le("height", 4), _le("channels - 1", 2), _le("layers - 1", 2), _le(packed, 3), "'07'"]
    parts += [_le(intent, 1), _le(encoder, 1), "'00'", _le(filters, 1), _le("metadata_size // 4", 4)]
    return f"SELECT image_id, {' || '.join(parts)} AS header FROM ({GOOD})"


def _pairs() -> list:
    """The coded events with their blocks, and each detail's known neighbours with weights, as a union of one select for each kind."""
    ctes = _events_coded()
    coded = ctes[-1][0]
    ctes.append(("cells", _blocked(ctes[-1][0], 32, 3)))
    ctes.append(
        ("targets", """SELECT *, level_step AS s, 2 * level_step AS t, y - block_y * side AS ly, x - block_x * side AS lx, least(side, 25 - block_y * side) AS bh,
            least(side, 40 - block_x * side) AS bw FROM cells WHERE (x | y) > 0""")
    )
    up, left = (f"({p} // (2 * t) * 2 * t + CASE WHEN {p} % t >= s THEN t ELSE 0 END)" for p in ("ly", "lx"))
    odd_y, odd_x = "ly % t >= s", "lx % t >= s"
    right = f"(CASE WHEN {odd_x} THEN lx ELSE lx + s END)"
    kinds = [
        (f"CASE WHEN {up} >= bh THEN {up} - t ELSE {up} END", f"CASE WHEN {left} >= bw THEN {left} - t ELSE {left} END", 2, "true"),
        ("ly - s", right, 2, f"{odd_y} AND {right} < bw"),
        ("ly", "lx - s", 2, f"{odd_y} AND {odd_x} AND lx < bw"),
    ]
    ring1, ring2 = "ly >= t AND lx >= t", "ly >= 2 * t AND lx >= 2 * t"
    for ring, r, weights in ((ring1, "t", (4, 4, 2, 2)), (ring2, "2 * t", (2, 2, 1, 1))):
        for (dy, dx), k in zip(((1, 0), (0, 1), (1, 1), (1, -1)), weights):
            kinds.append((f"ly - {dy} * {r}", f"lx - ({dx}) * {r}", k, f"{ring} AND lx - ({dx}) * {r} < bw"))
    union = " UNION ALL ".join(f"SELECT image_id, level_step, c, y, x, block_y * side + ({a}) AS sy, block_x * side + ({b}) AS sx, {k} AS k FROM targets WHERE {on}" for a, b, k, on in kinds)
    ctes.append(("pairs", union))
    sums = f"""SELECT pairs.image_id, level_step, pairs.c, pairs.y, pairs.x, sum(abs(v) * k) AS total,
        sum(CAST(least(abs(v), 4096) AS BIGINT) * least(abs(v), 4096) * k) AS squares, sum(k) AS n
        FROM pairs JOIN {coded} p ON p.image_id = pairs.image_id AND p.c = pairs.c AND p.y = sy AND p.x = sx GROUP BY ALL"""
    ctes.append(("sums", sums))
    mean = lambda v, name: f"CAST(({v} * 16 + n // 2) // n AS BIGINT) AS {name}"
    ctes.append(("moments", f"SELECT image_id, level_step, c, y, x, {mean('total', 'first')}, {mean('squares', 'second')} FROM sums"))
    return ctes


CHOICE = """SELECT image_id, y, x, CAST(pick // 10 AS INTEGER) AS interleaved, CAST(pick % 10 AS INTEGER) AS pot FROM (SELECT *, CASE
    WHEN f < 2 * second + 100 THEN 10 WHEN f < 2 * second + 950 THEN 11
    WHEN f < 3 * second + 3000 THEN CASE WHEN f < 5 * second + 400 THEN 1 ELSE 12 END
    WHEN f < 3 * second + 12000 THEN CASE WHEN f < 5 * second + 3000 THEN 2 ELSE 13 END
    WHEN f < 4 * second + 44000 THEN CASE WHEN f < 6 * second + 12000 THEN 3 ELSE 14 END ELSE 4 END AS pick
    FROM (SELECT *, first * first AS f FROM moments))"""


def _mixed(steps: list[str]) -> str:
    """Colour programs written out: each step names the new value of one channel."""
    query = f"SELECT image_id, y, x, 8 * raw0 AS ch0, 8 * raw1 AS ch1, 8 * raw2 AS ch2 FROM ({PIXELS})"
    for step in steps:
        query = f"SELECT * REPLACE (CAST({step.split('=', 1)[1]} AS INTEGER) AS {step.split('=', 1)[0]}) FROM ({query})"
    return _long(query, "ch", "v")


def _interleaved_at() -> str:
    return "CAST((y * 50 + x) * 3 + c AS BIGINT)"


def statements() -> dict[str, str]:
    out = {"raster_events": EVENTS, "raster_embeddings": EMBEDDINGS, "raster_orders": ORDERS}
    out["interleave_orders"] = f"SELECT image_id, {_interleaved_at()} AS pos, sample FROM ({ORDERS})"
    out["deinterleave_skip"] = f"SELECT image_id, CAST(CASE c WHEN 0 THEN 0 ELSE 1 END AS INTEGER) AS c, y, x, CAST(8 * sample AS INTEGER) AS v FROM ({ORDERS}) WHERE c <> 1"
    out["fill_skipped"] = f"SELECT image_id, {_interleaved_at()} AS pos, CAST(CASE c WHEN 1 THEN sample ELSE least(255, sample + 10) END AS INTEGER) AS sample FROM ({ORDERS})"
    out["plane_lines"] = f"SELECT image_id, c, y, string_agg(CAST(sample AS VARCHAR), ',' ORDER BY x) AS line FROM ({EVENTS}) GROUP BY image_id, c, y"
    out["color_uyv"] = _mixed(["ch0=ch0 - ch1", "ch2=ch2 - ch1", "ch1=ch1 + (ch0 + ch2) // 4"])
    out["color_a710_bgr"] = _mixed(["ch2=ch2 - ch1", "ch0=ch0 + (-2 * ch1 - ch2) // 2", "ch1=ch1 + (2 * ch0 + 3 * ch2) // 8"])
    out["color_a710_rgb"] = _mixed(["ch0=ch0 - ch1", "ch2=ch2 + (-2 * ch1 - ch0) // 2", "ch1=ch1 + (2 * ch2 + 3 * ch0) // 8"])
    out["color_roundtrip"] = ORDERS
    out["chroma_flags"] = """SELECT preset, CAST(i - 1 AS INTEGER) AS c, flags[i] AS is_chroma FROM (VALUES ('yuv444', [false, true, true]),
        ('uyv', [true, false, true]), ('a710_bgr', [true, false, true]), ('a710_rgb', [true, false, true])) p(preset, flags), (SELECT unnest([1, 2, 3]) AS i)"""
    out["lattice_histogram"] = f"SELECT c, {STEP} AS level_step, count(*) AS cells FROM ({ORDERS}) GROUP BY ALL"
    orders_blocked = _with([("o", ORDERS), ("b", _blocked("o", 32, 4))], "")
    down, across = "((30 + side - 1) // side)", "((50 + side - 1) // side)"
    out["block_grid"] = f"""{orders_blocked} SELECT level_step, c, block_y, block_x, CAST((c * {down} + block_y) * {across} + block_x AS INTEGER) AS block_index,
        count(*) AS cells, CAST(sum(sample) AS BIGINT) AS total FROM b GROUP BY ALL"""
    out["block_count"] = f"""SELECT image_id, CAST(s AS INTEGER) AS level_step, CAST(3 * ((30 + 16 * s - 1) // (16 * s)) * ((50 + 16 * s - 1) // (16 * s)) AS BIGINT) AS blocks
        FROM (SELECT DISTINCT image_id FROM ({PIXELS})), (SELECT unnest([1, 2, 4, 8, 16, 32]) AS s)"""
    for kind in ("linear", "cubic"):
        ctes = _boost(EVENTS)
        _lifting(ctes, kind, 40, 25, 1)
        out[f"lift_{kind}_l1"] = _select(ctes)
        ctes = _boost(EMBEDDINGS)
        _lifting(ctes, kind, 64, 20)
        out[f"lift_{kind}_full"] = _select(ctes)
        out[f"unlift_{kind}_roundtrip"] = EMBEDDINGS
    out["unlift_windows_l1"] = EVENTS
    ctes = [("p0", """SELECT doc_id AS image_id, 0 AS c, 0 AS y, CAST(i - 1 AS INTEGER) AS x, CAST(('0x' || substr(h, CAST(2 * i - 1 AS BIGINT), 2)) AS INTEGER) AS v
        FROM (SELECT doc_id, hex(encode(text)) AS h, unnest(range(1, length(hex(encode(text))) // 2 + 1)) AS i FROM documents)""")]  # fmt: skip
    _lifting(ctes, "linear", 1 << 20, 1, 1)
    out["text_lift_l1"] = _with(ctes, f"""SELECT image_id, count(*) AS n, CAST(sum(v) AS BIGINT) AS total, CAST(sum(v * CAST(x + 1 AS BIGINT)) AS BIGINT) AS weighted
        FROM {ctes[-1][0]} GROUP BY image_id""")  # fmt: skip
    ctes = _boost(ORDERS, 8)
    _lifting(ctes, "linear", 50, 30)
    by_channel = "(CASE WHEN c IN (0, 2) THEN 16 ELSE 124 END)"
    _quantised(ctes, by_channel, 8192, 30)
    out["quantize_q124"] = _select(ctes)
    _quantised(ctes, by_channel, 8192, 30, back=True)
    out["dequantize_q124"] = _select(ctes)
    ctes = _events_coded()
    out["subband_rate"] = _with(ctes, f"""SELECT c, {STEP} AS level_step, count(*) AS cells, count(CASE WHEN v <> 0 THEN 1 END) AS nonzero,
        CAST(sum(length({interleaved('v', 1)})) AS BIGINT) AS bits FROM {ctes[-1][0]} GROUP BY ALL""")  # fmt: skip
    _quantised(ctes, "124", 8192, 25, back=True)
    _lifting(ctes, "linear", 40, 25, inverse=True)
    off = "CAST(abs(greatest(0, least(255, v // 8)) - sample) AS BIGINT)"
    out["lossy_error_stats"] = _with(ctes, f"""SELECT image_id, c, count(*) AS samples, max(off) AS max_error, CAST(sum(off) AS BIGINT) AS sum_error,
        CAST(sum(off * off) AS BIGINT) AS sum_squares FROM (SELECT image_id, c, {off} AS off FROM {ctes[-1][0]} JOIN ({EVENTS}) USING (image_id, c, y, x)) GROUP BY ALL""")  # fmt: skip
    out["golomb_bits"] = f"""SELECT image_id, y, x, {unsigned('sample', 0)} AS unsigned_pot0, {interleaved('s', 2)} AS interleaved_pot2, {signed('s', 4)} AS signed_pot4
        FROM (SELECT *, sample - 100 AS s FROM ({EVENTS}))"""
    turbo = _turbo(_events_coded())
    out["turbo_runs"] = _with(turbo[:-5] + [turbo[-5]], "SELECT image_id, level_step, block_y, block_x, y, x, v, run FROM hits")
    out["turbo_block_hex"] = _with(turbo, f"SELECT image_id, CAST(level_step AS INTEGER) AS level_step, CAST(block_y AS INTEGER) AS block_y, CAST(block_x AS INTEGER) AS block_x, {BITS_HEX} AS words, n_words FROM words")
    out["turbo_level_table"] = _with(turbo, "SELECT image_id, CAST(level_step AS INTEGER) AS level_step, count(*) AS blocks, CAST(sum(n_words) AS BIGINT) AS words FROM words GROUP BY ALL")
    out["block_offsets"] = _offsets()
    out["point_of_interest"] = _interest()
    out["header_checks"] = f"SELECT image_id, CASE WHEN width = 0 THEN 'width' WHEN quality = 0 THEN 'quality' WHEN block_size = 1 THEN 'block_size' ELSE 'ok' END AS status FROM ({SPECS})"
    out["header_sizes"] = f"""SELECT image_id, width * height AS channel_size, width * height * channels * layers AS image_size,
        CAST(CASE quality WHEN 1024 THEN 1 ELSE 8 END AS INTEGER) AS boost, CAST(greatest(1, (quality + chroma_scale // 2) // chroma_scale) AS INTEGER) AS chroma_quality,
        CAST((width + 3) // 4 AS INTEGER) AS small_width, CAST((height + 3) // 4 AS INTEGER) AS small_height,
        ((width + 3) // 4) * ((height + 3) // 4) * channels * layers AS decoded_size FROM ({GOOD})"""
    out["header_hex"] = _header()
    ints = ", ".join(f"CAST({n} AS INTEGER) AS {n}" for n in ("width", "height", "channels", "layers", "quality", "chroma_scale", "block_size", "metadata_size"))
    out["header_fields"] = f"SELECT image_id, {ints}, filter, encoder, intent, 'ok' AS status FROM ({GOOD})"
    pairs = _pairs()
    out["context_moments"] = _select(pairs, "image_id, CAST(level_step AS INTEGER) AS level_step, c, y, x, first, second")
    out["code_choices"] = _with(pairs, CHOICE)
    for encoder in ("turbo", "fast", "contextual"):
        out[f"roundtrip_{encoder}"] = ORDERS
    out["roundtrip_blocks"] = EMBEDDINGS
    for n in (1, 2):
        ctes = _boost(EMBEDDINGS)
        _lifting(ctes, "linear", 64, 20, n)
        k = 1 << n
        out[f"downsample_{n}"] = _with(ctes, f"""SELECT image_id, c, CAST(y // {k} AS INTEGER) AS y, CAST(x // {k} AS INTEGER) AS x,
            CAST(greatest(0, least(255, v)) AS INTEGER) AS sample FROM {ctes[-1][0]} WHERE y % {k} = 0 AND x % {k} = 0""")  # fmt: skip
    out["container_status"] = f"SELECT DISTINCT image_id, CAST(0 AS BIGINT) AS point_of_interest, 'ok' AS status FROM ({EVENTS})"
    out["compare_equal"] = f"SELECT image_id, count(*) AS samples, count(CASE WHEN sample >= 200 THEN 1 END) AS different, max(sample) < 200 AS equal FROM ({EVENTS}) GROUP BY image_id"
    return out
