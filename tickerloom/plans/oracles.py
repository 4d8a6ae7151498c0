"""The registered queries as SQL for DuckDB over the same parquet tables."""

from __future__ import annotations

from tickerloom.params import LARGE_COST, SMALL_COST, UNIVERSE_SIZE

# Fixed value: the public English stop list of Spark ML, as ``english_stop_words`` loads it.
STOP_WORDS = """
i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it its
itself they them their theirs themselves what which who whom this that these those am is are was were be been being have
has had having do does did doing a an the and but if or because as until while of at by for with about against between
into through during before after above below to from up down in out on off over under again further then once here there
when where why how all any both each few more most other some such no nor not only own same so than too very s t can will
just don should now i'll you'll he'll she'll we'll they'll i'd you'd he'd she'd we'd they'd i'm you're he's she's it's
we're they're i've we've you've they've isn't aren't wasn't weren't haven't hasn't hadn't don't doesn't didn't won't
wouldn't shan't shouldn't mustn't can't couldn't cannot could here's how's let's ought that's there's what's when's
where's who's why's would
""".split()

_STOP = ", ".join("'" + word.replace("'", "''") + "'" for word in STOP_WORDS)
_WORDS = r"regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]{{2,}}')"


def _friday(day: str) -> str:
    return f"CAST({day} + CAST((5 - isodow({day}) + 7) % 7 AS INT) AS DATE)"


def _q(value: str, digits: int = 6) -> str:
    """The value on a decimal grid, as ``rounded`` in queries.py does it."""
    return f"floor(({value}) * 1e{digits} + 0.5137) / 1e{digits}"


def _r(column: str, digits: int = 6, name: str | None = None) -> str:
    return f"{_q(column, digits)} AS {name or column}"


def _bars(source: str, keys: str = "") -> str:
    return f"""
        SELECT {keys} permco, ticker, CAST({_friday('date')} - 4 AS DATE) start_date, {_friday('date')} end_date,
               coalesce(product(1 + ret) - 1, 0) * 100 weekly_ret,
               arg_max(prc / cfacpr, struct_pack(a := date, b := rec_id, c := rec_line, d := prc / cfacpr)) adj_prc
        FROM {source} WHERE prc > 0 AND ret IS NOT NULL GROUP BY ALL"""


def _direction(source: str, keys: str = "") -> str:
    return f"""
        SELECT *, CASE WHEN adj_prc - lag(adj_prc) OVER (PARTITION BY {keys} permco, ticker ORDER BY end_date) < 0
                       THEN 'Down' ELSE 'Up' END direction FROM {source}"""


def _period(day: str) -> str:
    return f"""CASE WHEN {day} BETWEEN DATE '1995-01-01' AND DATE '1998-12-31' THEN 'estimation'
                    WHEN {day} BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' THEN 'out_of_sample' END"""


_ORDER_LINES = "orders JOIN lineitem ON o_orderkey = l_orderkey JOIN part ON l_partkey = p_partkey"
_TEXT_KEY = "lpad(CAST(l_suppkey AS VARCHAR), 6, '0')"
_METRICS = """
    count(*) FILTER (true_direction = 0 AND predicted_direction = 0) tn,
    count(*) FILTER (true_direction = 0 AND predicted_direction = 1) fp,
    count(*) FILTER (true_direction = 1 AND predicted_direction = 0) fn,
    count(*) FILTER (true_direction = 1 AND predicted_direction = 1) tp"""
_RATES = """
    (tp + tn) / nullif(tp + tn + fp + fn, 0) accuracy, coalesce(tp / nullif(tp + fp, 0), 0.0) "precision",
    coalesce(tp / nullif(tp + fn, 0), 0.0) recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0.0) f1"""

# Building blocks; each may use the ones before it.
_STEPS: dict[str, str] = {
    "panel_daily": """
        SELECT l_suppkey permno, l_suppkey permco, concat('T', CAST(l_suppkey AS VARCHAR)) ticker, s_name comnam,
               5000 + s_nationkey * 50 siccd, CASE WHEN s_nationkey % 2 = 0 THEN 1 ELSE 2 END exchcd,
               CAST(l_shipdate AS DATE) date,
               CASE WHEN l_linenumber = 7 THEN -1 ELSE 1 END * l_extendedprice / l_quantity prc,
               l_quantity * 100 shrout, 1.0 + l_tax cfacpr,
               CASE WHEN l_returnflag = 'R' AND l_linestatus = 'F' THEN NULL ELSE l_discount - 0.05 END ret,
               l_orderkey rec_id, l_linenumber rec_line
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey""",
    "stock_names": """
        SELECT s_suppkey permno, concat(s_name, suffix) comnam, concat('T', CAST(s_suppkey AS VARCHAR)) ticker,
               5000 + s_nationkey * 50 siccd, first_day, last_day
        FROM supplier, (VALUES ('', DATE '1900-01-01', DATE '1997-12-31'),
                               (' II', DATE '1998-01-01', DATE '2099-12-31')) h(suffix, first_day, last_day)""",
    "link_table": """
        SELECT lpad(CAST(s_suppkey AS VARCHAR), 6, '0') gvkey, s_suppkey + extra lpermno, s_suppkey lpermco
        FROM supplier, (VALUES (0), (1000000)) e(extra) WHERE s_acctbal >= 0 AND (extra = 0 OR s_nationkey < 5)""",
    "news_linked": f"""
        SELECT DISTINCT o_orderkey keydevid, l_suppkey permco, CAST(o_orderdate AS DATE) announcedate,
               o_orderpriority eventtype, concat_ws(' ', p_name, o_orderpriority) headline FROM {_ORDER_LINES}""",
    "news_events": f"""
        SELECT DISTINCT o_orderkey keydevid, {_TEXT_KEY} gvkey, CAST(o_orderdate AS DATE) announcedate,
               CASE WHEN l_returnflag <> 'R' THEN p_name END headline FROM {_ORDER_LINES}""",
    "news_detail": f"""
        SELECT DISTINCT o_orderkey keydevid, CASE WHEN l_returnflag <> 'R' THEN p_name END headline, p_type situation
        FROM {_ORDER_LINES}""",
    "bars": _bars("panel_daily"),
    "weekly": _direction("bars"),
    "panel": f"""
        SELECT w.*, coalesce(n.headline, 'No_Headlines') headline
        FROM weekly w LEFT JOIN (SELECT *, {_friday('announcedate')} + 7 AS next_friday FROM news_linked) n
          ON w.permco = n.permco AND w.end_date = n.next_friday""",
    "panel_rows": "SELECT DISTINCT permco, ticker, end_date, headline, adj_prc FROM panel",
    "period_daily": f"SELECT *, {_period('date')} period FROM panel_daily WHERE {_period('date')} IS NOT NULL",
    "period_bars": _direction(f"({_bars('period_daily', 'period,')})", "period,"),
    "period_panel": f"""
        SELECT w.*, coalesce(n.headline, 'No_Headlines') headline
        FROM period_bars w LEFT JOIN
             (SELECT *, {_period('announcedate')} period, {_friday('announcedate')} + 7 AS next_friday FROM news_linked) n
          ON w.permco = n.permco AND w.end_date = n.next_friday AND w.period = n.period""",
    "clean_rows": """
        SELECT DISTINCT period, permco, ticker, start_date, end_date, weekly_ret, adj_prc, headline,
               CASE direction WHEN 'Up' THEN 1 WHEN 'Down' THEN 0 END direction FROM period_panel""",
    "predictions": """
        SELECT permco, ticker, end_date, year(end_date) "year", y true_direction, m.model,
               CASE m.model WHEN 'momentum' THEN p1 WHEN 'reversal' THEN 1 - p1 ELSE tr END predicted_direction
        FROM (SELECT permco, ticker, end_date, CASE WHEN direction = 'Up' THEN 1 ELSE 0 END y,
                     lag(CASE WHEN direction = 'Up' THEN 1 ELSE 0 END) OVER w p1,
                     CASE WHEN lag(adj_prc, 1) OVER w > lag(adj_prc, 4) OVER w THEN 1 ELSE 0 END tr,
                     lag(adj_prc, 4) OVER w l4
              FROM weekly WINDOW w AS (PARTITION BY permco, ticker ORDER BY end_date)) b
        CROSS JOIN (VALUES ('momentum'), ('reversal'), ('trend')) m(model)
        WHERE l4 IS NOT NULL AND end_date >= DATE '1999-01-01'""",
    "metrics": f"""
        SELECT *, {_RATES} FROM (SELECT permco, "year", model, {_METRICS} FROM predictions GROUP BY ALL)""",
    "later_daily": "SELECT * FROM panel_daily WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'",
    "later_bars": _bars("later_daily"),
    "all_sizes": """
        SELECT *, CASE WHEN cap >= median_cap THEN 'Large' ELSE 'Small' END size_class
        FROM (SELECT *, prc * shrout cap, median(prc * shrout) OVER (PARTITION BY date) median_cap
              FROM panel_daily WHERE exchcd = 1 AND prc IS NOT NULL AND shrout IS NOT NULL AND date IS NOT NULL)""",
    "sizes": """
        SELECT date, ticker, min(size_class) size_class FROM all_sizes
        WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' GROUP BY ALL""",
    "period_returns": """
        SELECT ticker, start_date, adj_prc price,
               adj_prc / lag(adj_prc) OVER (PARTITION BY ticker ORDER BY start_date) - 1.0 ret FROM later_bars""",
    "net": f"""
        SELECT p.ticker, start_date, ret, size_class, CASE WHEN size_class = 'Large' THEN {LARGE_COST!r} ELSE {SMALL_COST!r} END AS cost,
               ret - CASE WHEN size_class = 'Large' THEN {LARGE_COST!r} ELSE {SMALL_COST!r} END net_ret
        FROM period_returns p LEFT JOIN sizes s ON s.date = p.start_date AND s.ticker = p.ticker WHERE ret IS NOT NULL""",
    "weekly_ret": """
        SELECT CAST(date_trunc('week', start_date) AS DATE) AS week, ticker, coalesce(product(1 + ret) - 1, 0) ret,
               coalesce(product(1 + net_ret) - 1, 0) net_ret FROM net GROUP BY ALL""",
    "scenario_ret": """
        SELECT 'Without Transaction Cost' scenario, week, ticker, ret FROM weekly_ret
        UNION ALL SELECT 'With Transaction Cost', week, ticker, net_ret FROM weekly_ret""",
    "scores": """
        SELECT model, ticker, avg(predicted_direction) score FROM predictions
        WHERE ticker IN (SELECT ticker FROM later_bars) GROUP BY ALL""",
    "picks": """
        SELECT * FROM (SELECT *, 'long' leg, row_number() OVER (PARTITION BY model ORDER BY score DESC, ticker DESC) leg_rank
                       FROM scores) WHERE leg_rank <= 10
        UNION ALL
        SELECT * FROM (SELECT *, 'short' leg, row_number() OVER (PARTITION BY model ORDER BY score, ticker) leg_rank
                       FROM scores) WHERE leg_rank <= 10""",
    "weights": """
        SELECT *, 1.0 / count(*) OVER (PARTITION BY model, leg) ew,
               score / nullif(sum(score) OVER (PARTITION BY model, leg), 0) vw FROM picks""",
    "legs": """
        SELECT g.model, g.scenario, g.week,
               coalesce(sum(ew * ret) FILTER (leg = 'long'), 0) ew_l, coalesce(sum(ew * ret) FILTER (leg = 'short'), 0) ew_s,
               coalesce(sum(vw * ret) FILTER (leg = 'long'), 0) vw_l, coalesce(sum(vw * ret) FILTER (leg = 'short'), 0) vw_s
        FROM (SELECT DISTINCT model, scenario, week FROM scenario_ret, (SELECT DISTINCT model FROM weights)) g
        LEFT JOIN (SELECT r.*, w.model, leg, ew, vw FROM scenario_ret r JOIN weights w USING (ticker)) e
          ON e.model = g.model AND e.scenario = g.scenario AND e.week = g.week
        GROUP BY ALL""",
    "series": """
        SELECT model, scenario, week, 'EW L' AS type, ew_l ret FROM legs
        UNION ALL SELECT model, scenario, week, 'EW S', ew_s FROM legs
        UNION ALL SELECT model, scenario, week, 'EW LS', ew_l - ew_s FROM legs
        UNION ALL SELECT model, scenario, week, 'VW L', vw_l FROM legs
        UNION ALL SELECT model, scenario, week, 'VW S', vw_s FROM legs
        UNION ALL SELECT model, scenario, week, 'VW LS', vw_l - vw_s FROM legs""",
    "risk": """
        SELECT model, scenario, type, avg(ret) ret, stddev_samp(ret) std, avg(ret) / nullif(stddev_samp(ret), 0) sr
        FROM series GROUP BY ALL""",
    "size_lines": """
        SELECT CASE WHEN l_linenumber = 6 THEN 'not a day' ELSE CAST(CAST(l_shipdate AS DATE) AS VARCHAR) END day_text,
               concat('T', CAST(l_suppkey AS VARCHAR)) ticker, 1 exchcd,
               CASE WHEN l_linenumber = 2 THEN 'C' ELSE CAST(l_extendedprice AS VARCHAR) END prc_text,
               CASE WHEN l_linenumber <> 3 THEN CAST(l_quantity AS VARCHAR) END shrout_text
        FROM lineitem WHERE l_linenumber <> 5""",
}


def _with(needed: str, select: str, available: dict[str, str] = _STEPS) -> str:
    """The select, preceded by the needed steps and theirs; a select that starts with a comma adds its own."""
    names = list(available)
    used: set[str] = set()

    def visit(name: str) -> None:
        used.add(name)
        body = available[name]
        for other in names[: names.index(name)]:
            if other not in used and _mentions(body, other):
                visit(other)

    for name in needed.split():
        visit(name)
    steps = ",\n".join(f"{name} AS ({available[name]})" for name in names if name in used)
    return f"WITH {steps}\n{select}"


def _mentions(body: str, name: str) -> bool:
    padded = "".join(ch if ch.isalnum() or ch == "_" else " " for ch in body)
    return name in padded.split()


_DAILY = f"""permno, permco, ticker, comnam, siccd, exchcd, date, {_r('prc')}, {_r('shrout')}, {_r('cfacpr')}, {_r('ret')},
    rec_id, rec_line"""
_BAR = f"permco, ticker, start_date, end_date, {_r('weekly_ret')}, {_r('adj_prc')}"
_SQL_PANEL = f"""
    SELECT p.permno, p.permco, n.comnam, n.ticker, p.date, {_r('p.prc', name='prc')}, {_r('p.shrout', name='shrout')},
           {_r('p.cfacpr', name='cfacpr')}, {_r('p.ret', name='ret')}
    FROM panel_daily p JOIN stock_names n ON p.permno = n.permno
    WHERE n.siccd BETWEEN 5500 AND 6000 AND p.date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'"""
_COMPLETE = """SELECT DISTINCT * FROM panel_daily WHERE prc IS NOT NULL AND ret IS NOT NULL AND comnam IS NOT NULL
    AND date IS NOT NULL AND shrout IS NOT NULL AND cfacpr IS NOT NULL"""
_TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings",
           "pages", "benchmark", "labels", "conversations"]
_DAILY_TYPES = {
    "permno": "bigint", "permco": "bigint", "ticker": "string", "comnam": "string", "siccd": "int", "exchcd": "int",
    "date": "date", "prc": "double", "shrout": "double", "cfacpr": "double", "ret": "double", "rec_id": "bigint",
    "rec_line": "int",
}


def _universe(where: str) -> str:
    return f"""SELECT permno, avg(prc * shrout) avg_cap, min(comnam) comnam FROM panel_daily
        WHERE {where} AND date BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'
        GROUP BY permno ORDER BY avg_cap DESC NULLS LAST, permno LIMIT {UNIVERSE_SIZE}"""


def _chain_steps() -> dict[str, str]:
    """The building blocks over the universe, with linked news and sizes from the size file."""
    first = {name: _STEPS[name] for name in ("panel_daily", "link_table", "news_events", "size_lines")}
    changed = {
        "listed": _universe("siccd BETWEEN 5500 AND 6000"),
        "listed_daily": "SELECT * FROM panel_daily WHERE permno IN (SELECT permno FROM listed)",
        "news_linked": """SELECT lpermco permco, announcedate, headline FROM news_events JOIN link_table USING (gvkey)
            WHERE lpermno IN (SELECT permno FROM listed)""",
        "bars": _bars("listed_daily"),
        "period_daily": f"SELECT *, {_period('date')} period FROM listed_daily WHERE {_period('date')} IS NOT NULL",
        "later_daily": "SELECT * FROM listed_daily WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'",
        "all_sizes": """
            SELECT *, CASE WHEN cap >= median(cap) OVER (PARTITION BY date) THEN 'Large' ELSE 'Small' END size_class
            FROM (SELECT TRY_CAST(day_text AS DATE) date, ticker, TRY_CAST(prc_text AS DOUBLE) * TRY_CAST(shrout_text AS DOUBLE) cap FROM size_lines)
            WHERE cap IS NOT NULL AND date IS NOT NULL""",
    }
    rest = {name: body for name, body in _STEPS.items() if name not in {**first, **changed}}
    rest["picks"] = rest["picks"].replace("leg_rank <= 10", "leg_rank <= 3")
    return {**first, **changed, **rest}


def _union(parts: list[str]) -> str:
    return " UNION ALL ".join(parts)


def _stats_row(name: str, column: str) -> str:
    return f"""SELECT '{name}' column_name, count({column}) n, {_r(f'avg({column})', 3, 'mean')},
        {_r(f'stddev_samp({column})', 3, 'std')}, {_r(f'min({column})', 3, '"min"')}, {_r(f'max({column})', 3, '"max"')},
        {_r(f'quantile_cont({column}, 0.25)', 3, 'q25')}, {_r(f'quantile_cont({column}, 0.5)', 3, 'q50')},
        {_r(f'quantile_cont({column}, 0.75)', 3, 'q75')} FROM d"""


def _moving_average(partition: str, order: str) -> str:
    frame = f"OVER ({partition} ORDER BY {order} ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)"
    return f"""SELECT permco, ticker, end_date, headline, {_r('adj_prc')},
        {_q(f"CASE WHEN count(adj_prc) {frame} = 5 THEN avg(adj_prc) {frame} END")} AS ma5 FROM panel_rows"""


def _best(key: str) -> str:
    return f"""SELECT {key}, model best_model, accuracy FROM
        (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY accuracy DESC, model) r
         FROM (SELECT {key}, model, avg(accuracy) accuracy FROM metrics GROUP BY ALL)) WHERE r = 1"""


_RATE_COLUMNS = f"""{_r('accuracy')}, {_r('"precision"', name='"precision"')}, {_r('recall')}, {_r('f1')}"""
_CELLS = ", ".join(
    f"""round(max({source}) FILTER (model = '{model}'), 3) + 0.0 AS "{name} {model}" """
    for model in ("momentum", "reversal", "trend") for name, source in (("Return", "ret"), ("Std", "std"), ("SR", "sr"))
)
def _ranks(value: str) -> str:
    return ", ".join(f"{_q(f'max({value}) FILTER (place = {n})')} AS top_{n:02d}" for n in range(1, UNIVERSE_SIZE + 1))


def _matrix(value: str) -> str:
    return _with("weekly_ret", f"""
        , u AS ({_universe('true')}),
        l AS (SELECT concat('T', CAST(permno AS VARCHAR)) ticker, row_number() OVER (ORDER BY avg_cap DESC, permno) place FROM u)
        SELECT week, {_ranks(value)} FROM weekly_ret JOIN l USING (ticker) GROUP BY week""")


_DOC_WORDS = _WORDS.format("text")
_EMBEDDING = f"""
    WITH t AS (SELECT doc_id, unnest({_DOC_WORDS}) w FROM documents),
    b AS (SELECT doc_id, CAST(CAST('0x' || substr(md5(w), 1, 8) AS BIGINT) % 64 AS INT) bucket, count(*) n FROM t GROUP BY ALL)
    SELECT doc_id, bucket, {_q('n / sum(n) OVER (PARTITION BY doc_id)')} AS value FROM b"""


# Murmur3 (32 bits, seed 42) of the UTF-8 bytes of a word, step by step, as the hash of Spark ML's HashingTF.
_MASK = "4294967295::UBIGINT"


def _rotated(x: str, bits: int) -> str:
    return f"((({x}) << {bits}) | (({x}) >> {32 - bits})) & {_MASK}"


def _mixed_block(k: str) -> str:
    first = f"(({k}) * 3432918353::UBIGINT) & {_MASK}"
    return f"(({_rotated(first, 15)}) * 461845907::UBIGINT) & {_MASK}"


_MURMUR = f"""
    hex_words AS (SELECT DISTINCT w, hex(w) x, CAST(length(hex(w)) // 2 AS BIGINT) n FROM words),
    blocks AS (
        SELECT w, n, list_transform(range(0, n // 4), lambda i: CAST('0x' || substr(x, i * 8 + 7, 2) || substr(x, i * 8 + 5, 2)
                   || substr(x, i * 8 + 3, 2) || substr(x, i * 8 + 1, 2) AS UBIGINT)) body,
               coalesce(list_sum(list_transform(range(0, n % 4), lambda i: CAST('0x' || substr(x, (n // 4) * 8 + i * 2 + 1, 2) AS UBIGINT)
                   * CAST(pow(256, i) AS UBIGINT))), 0)::UBIGINT tail FROM hex_words),
    mixed AS (SELECT w, n, tail, list_transform(body, lambda k: {_mixed_block('k')}) body FROM blocks),
    h0 AS (SELECT w, n, tail, list_reduce(list_prepend(42::UBIGINT, body),
               lambda h, k: (({_rotated('xor(h, k)', 13)}) * 5 + 3864292196::UBIGINT) & {_MASK}) h FROM mixed),
    h1 AS (SELECT w, xor(CASE WHEN tail > 0 THEN xor(h, {_mixed_block('tail')}) ELSE h END, n::UBIGINT) h FROM h0),
    h2 AS (SELECT w, (xor(h, h >> 16) * 2246822507::UBIGINT) & {_MASK} h FROM h1),
    h3 AS (SELECT w, (xor(h, h >> 13) * 3266489909::UBIGINT) & {_MASK} h FROM h2),
    h4 AS (SELECT w, xor(h, h >> 16) h FROM h3),
    buckets AS (SELECT w, CAST((CASE WHEN h >= 2147483648 THEN CAST(h AS BIGINT) - 4294967296 ELSE CAST(h AS BIGINT) END % 4096 + 4096) % 4096 AS INT) bucket FROM h4),
    cells AS (SELECT doc_id, bucket, count(*) n FROM words JOIN buckets USING (w) GROUP BY ALL),
    weights AS (
        SELECT bucket, count(*) documents, ln(((SELECT count(*) FROM labelled WHERE doc_id % 2 = 0) + 1) / (count(*) + 1)) idf
        FROM cells WHERE doc_id % 2 = 0 GROUP BY ALL)"""
_POOLED = f"""
    WITH labelled AS (SELECT doc_id, lang, text, quality label FROM documents JOIN labels USING (doc_id)),
    words AS MATERIALIZED (SELECT doc_id, unnest({_DOC_WORDS}) w FROM labelled), {_MURMUR}
"""


_PAIRS = f"""
    WITH lists AS (SELECT {_DOC_WORDS} w FROM documents),
    near AS (
        SELECT unnest(list_transform(range(1, len(w)), lambda i: struct_pack(x := w[i], y := w[i + 1]))) p FROM lists
        UNION ALL SELECT unnest(list_transform(range(1, len(w) - 1), lambda i: struct_pack(x := w[i], y := w[i + 2]))) FROM lists),
    pairs AS MATERIALIZED (SELECT least(p.x, p.y) a, greatest(p.x, p.y) b, count(*) n FROM near GROUP BY ALL)"""


# The regularised logistic loss by descent with a safe step (one over the largest row sum of the curvature's bound), one
# recursion step a pass; ``problems`` has (id, rows: list of (x with a one at the end, y)).
_MATRIX = "list_transform(range(1, len(rows[1].x) + 1), lambda j: list_transform(range(1, len(rows[1].x) + 1), lambda k: list_sum(list_transform(rows, lambda r: r.x[j] * r.x[k]))))"


def _descent(passes: int) -> str:
    miss = "list_transform(p.rows, lambda r: 1 / (1 + exp(-list_dot_product(d.w, r.x))) - r.y)"
    return f"""
        bounds AS MATERIALIZED (
            SELECT id, rows, 1 + list_max(list_transform({_MATRIX}, lambda row: list_sum(list_transform(row, lambda v: abs(v))))) / 4 bound FROM problems),
        d AS (
            SELECT 0 pass, id, list_transform(rows[1].x, lambda v: 0.0::DOUBLE) w FROM bounds
            UNION ALL
            SELECT d.pass + 1, d.id, list_transform(range(1, len(d.w) + 1), lambda j:
                d.w[j] - (list_sum(list_transform(list_zip(p.rows, {miss}), lambda z: z[1].x[j] * z[2]))
                          + CASE WHEN j < len(d.w) THEN d.w[j] ELSE 0 END) / p.bound)
            FROM d JOIN bounds p USING (id) WHERE d.pass < {passes})"""


def _epoch(e: int) -> str:
    """One pass of the descent: steps of eight rows in the order of the pass for every shard, then the mean by rows."""
    before = "start" if e == 1 else f"mean{e - 1}"
    miss = "list_transform(b.rows, lambda r: 1 / (1 + exp(list_dot_product(s.w0, r.x) - list_dot_product(s.w1, r.x))) - r.y)"
    moved = "list_sum(list_transform(list_zip(b.rows, b_miss), lambda z: z[1].x[j] * z[2])) * 0.5 / len(b.rows)"
    return f"""
        o{e} AS (SELECT permco, shard, x, y, (row_number() OVER (PARTITION BY permco, shard ORDER BY turn{e}, mix) - 1) // 8 + 1 step,
                        row_number() OVER (PARTITION BY permco, shard ORDER BY turn{e}, mix) place FROM train),
        b{e} AS MATERIALIZED (SELECT permco, shard, step, list(struct_pack(x := x, y := y) ORDER BY place) rows FROM o{e} GROUP BY ALL),
        s{e} AS (
            SELECT 0::BIGINT step, permco, shard, w0, w1, 0.0::DOUBLE loss FROM {before} JOIN (SELECT DISTINCT permco, shard FROM train) USING (permco)
            UNION ALL
            SELECT step, permco, shard, list_transform(range(1, len(w0) + 1), lambda j: w0[j] + {moved.replace('b.rows', 'rows')}),
                   list_transform(range(1, len(w1) + 1), lambda j: w1[j] - {moved.replace('b.rows', 'rows')}),
                   list_avg(list_transform(b_miss, lambda m: -ln(1 - abs(m))))
            FROM (SELECT s.step + 1 step, s.permco, s.shard, s.w0, s.w1, b.rows, {miss} b_miss
                  FROM s{e} s JOIN b{e} b ON b.permco = s.permco AND b.shard = s.shard AND b.step = s.step + 1)),
        last{e} AS (SELECT permco, shard, arg_max(w0, step) w0, arg_max(w1, step) w1 FROM s{e} GROUP BY ALL),
        n{e} AS (SELECT permco, shard, count(*) n FROM train GROUP BY ALL),
        mean{e} AS (
            SELECT permco, list(a ORDER BY j) w0, list(b ORDER BY j) w1
            FROM (SELECT permco, j, sum(n * w0[j]) / sum(n) a, sum(n * w1[j]) / sum(n) b
                  FROM last{e} JOIN n{e} USING (permco, shard), range(1, 18) t(j) GROUP BY ALL) GROUP BY permco)"""


_TRAINED = f"""
    WITH RECURSIVE vectors AS (
        SELECT vec_id, vec_id % 2 permco, CASE WHEN label >= 5 THEN 1 ELSE 0 END y, list_append(CAST(embedding[1:16] AS DOUBLE[]), 1.0) x,
               CAST('0x' || substr(md5(CAST(vec_id AS VARCHAR)), 1, 15) AS BIGINT) mix FROM embeddings),
    train AS MATERIALIZED (
        SELECT *, mix % 4 shard, {", ".join(f"CAST('0x' || substr(md5('{e}:' || CAST(mix AS VARCHAR)), 1, 15) AS BIGINT) turn{e}" for e in (1, 2, 3))}
        FROM vectors WHERE vec_id % 5 < 3),
    start AS (SELECT DISTINCT permco, list_transform(range(0, 17), lambda i: 0.0::DOUBLE) w0, list_transform(range(0, 17), lambda i: 0.0::DOUBLE) w1 FROM train),
    {", ".join(_epoch(e) for e in (1, 2, 3))}
"""


def _accuracy(e: int) -> str:
    return f"""SELECT permco, 'eval_accuracy' kind, {e} epoch, NULL shard, NULL step,
        {_q(f'avg(CASE WHEN (list_dot_product(w1, x) > list_dot_product(w0, x)) = (y = 1) THEN 1.0::DOUBLE ELSE 0.0 END)')} AS value
        FROM vectors JOIN mean{e} USING (permco) WHERE vec_id % 5 >= 3 GROUP BY permco"""


def build() -> dict[str, str]:
    return {
        "sql_daily_panel": _with("panel_daily stock_names", _SQL_PANEL),
        "sql_daily_panel_asof": _with("panel_daily stock_names", _SQL_PANEL + " AND p.date BETWEEN n.first_day AND n.last_day"),
        "list_tables": _union([f"SELECT '{name}' table_name, count(*) n_rows FROM {name}" for name in _TABLES]),
        "csv_roundtrip": _with("panel_daily", f"SELECT {_DAILY} FROM panel_daily"),
        "csv_skip_bad_lines": _with("size_lines", "SELECT * FROM size_lines"),
        "coerce_numeric": _with("size_lines", """
            SELECT ticker, prc_text, TRY_CAST(prc_text AS DOUBLE) prc, TRY_CAST(shrout_text AS DOUBLE) shrout FROM size_lines"""),
        "coerce_date": _with("size_lines", """
            SELECT ticker, day_text, TRY_CAST(day_text AS DATE) AS day,
                   CASE WHEN TRY_CAST(day_text AS DATE) IS NOT NULL THEN day_text || ' 09:30:00' END clock FROM size_lines"""),
        "partitioned_write_read": _with("period_bars", f"""
            SELECT {_BAR}, direction, CASE period WHEN 'estimation' THEN 'train' ELSE 'test' END split FROM period_bars"""),
        "collect_predictions": _with("predictions", """
            SELECT permco, model, ticker, end_date, true_direction, predicted_direction FROM predictions"""),
        "market_cap": _with("panel_daily", f"""
            SELECT permno, date, rec_id, rec_line, {_r('prc * shrout', name='market_cap')} FROM panel_daily"""),
        "clean_daily": _with("panel_daily", f"SELECT {_DAILY} FROM ({_COMPLETE})"),
        "null_report": _with("panel_daily", _union(
            [f"SELECT '{c}' column_name, count(*) - count({c}) n_null FROM panel_daily" for c in _DAILY_TYPES])),
        "schema_profile": _with("panel_daily", _union(
            [f"SELECT '{c}' column_name, '{t}' data_type, count({c}) non_null FROM panel_daily" for c, t in _DAILY_TYPES.items()])),
        "summary_stats": _with("panel_daily", f"""
            SELECT * FROM (WITH d AS (SELECT * FROM panel_daily WHERE ret IS NOT NULL) """ + _union(
            [_stats_row(c, c) for c in ("prc", "shrout", "cfacpr", "ret")] + [_stats_row("market_cap", "prc * shrout")]) + ")"),
        "market_cap_histogram": _with("panel_daily", f"""
            SELECT CAST(g.bin AS INT) AS bin, {_r('lo + (g.bin - 1) * ((hi - lo) / 50)', 4, 'bin_low')},
                   {_r('lo + g.bin * ((hi - lo) / 50)', 4, 'bin_high')}, coalesce(n, 0) n
            FROM range(1, 51) g(bin) CROSS JOIN (SELECT min(prc * shrout) lo, max(prc * shrout) hi FROM panel_daily)
            LEFT JOIN (SELECT least(CAST(floor(50.0 * (prc * shrout - lo) / (hi - lo)) AS INT) + 1, 50) bin, count(*) n
                       FROM panel_daily, (SELECT min(prc * shrout) lo, max(prc * shrout) hi FROM panel_daily) GROUP BY ALL) c
              ON c.bin = g.bin"""),
        "event_type_top": _with("news_linked", """
            SELECT eventtype, count(*) n FROM news_linked WHERE eventtype IS NOT NULL GROUP BY ALL ORDER BY n DESC, eventtype LIMIT 20"""),
        "first_rows": _with("panel_daily", f"""
            SELECT date, comnam, permno, rec_id, rec_line, {_r('prc')} FROM
            (SELECT * FROM panel_daily ORDER BY date, comnam, permno, rec_id, rec_line, prc LIMIT 25)"""),
        "avg_market_cap": _with("panel_daily", f"""
            SELECT permno, {_r('avg(prc * shrout)', 2, 'avg_cap')}, min(comnam) comnam FROM panel_daily GROUP BY permno"""),
        "market_cap_by_date": _with("panel_daily", f"SELECT date, {_r('avg(prc * shrout)', 2, 'avg_cap')} FROM panel_daily GROUP BY date"),
        "universe_topn": _with("panel_daily", f"SELECT permno, {_r('avg_cap', 2)}, comnam FROM ({_universe('siccd BETWEEN 5500 AND 6000')})"),
        "universe_filter": _with("panel_daily", f"""
            SELECT permno, date, {_r('prc')}, {_r('shrout')}, {_r('ret')}, rec_id, rec_line FROM panel_daily
            WHERE date BETWEEN DATE '1999-01-01' AND DATE '2001-12-31'
              AND permno IN (SELECT permno FROM ({_universe('siccd BETWEEN 5500 AND 6000')}))"""),
        "event_link_join": _with("news_events link_table", """
            SELECT e.gvkey, keydevid, announcedate, headline, lpermno, lpermco
            FROM news_events e LEFT JOIN (SELECT DISTINCT * FROM link_table) l ON e.gvkey = l.gvkey"""),
        "event_detail_join": _with("news_events news_detail", """
            SELECT e.*, situation FROM news_events e LEFT JOIN news_detail d
              ON e.keydevid = d.keydevid AND e.headline IS NOT DISTINCT FROM d.headline"""),
        "event_detail_join_estimation": _with("news_events news_detail", """
            , known AS MATERIALIZED (
                SELECT DISTINCT keydevid FROM news_events WHERE announcedate BETWEEN DATE '1995-01-01' AND DATE '1998-12-31'),
            d AS MATERIALIZED (
                SELECT keydevid, coalesce(headline, '') h, headline IS NULL gap, situation FROM news_detail JOIN known USING (keydevid)),
            e AS MATERIALIZED (SELECT *, coalesce(headline, '') h, headline IS NULL gap FROM news_events)
            SELECT e.* EXCLUDE (h, gap), situation FROM e LEFT JOIN d ON e.keydevid = d.keydevid AND e.h = d.h AND e.gap = d.gap"""),
        "week_keys": f"""
            WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders)
            SELECT o_orderkey, day, {_friday('day')} week_end, CAST({_friday('day')} - 4 AS DATE) week_start,
                   CAST({_friday('day')} + 7 AS DATE) next_friday, CAST(date_trunc('week', day) AS DATE) calendar_week,
                   CAST(year(day) AS INT) AS "year", CAST(year(day) * 4 + quarter(day) - 1 AS INT) quarter_index FROM o""",
        "weekly_bars": _with("bars", f"SELECT {_BAR} FROM bars"),
        "direction": _with("weekly", f"SELECT {_BAR}, direction FROM weekly"),
        "news_lag_join": _with("panel", f"SELECT {_BAR}, headline, direction FROM panel"),
        "clean_panel": _with("clean_rows", f"""
            SELECT period, permco "Permco", ticker "Ticker", start_date "Start_Date", end_date "End_Date",
                   {_r('weekly_ret', name='"Weekly_Return"')}, {_r('adj_prc', name='"Adjusted_Price"')},
                   headline "Headline", direction "Direction" FROM clean_rows"""),
        "ma5_by_ticker": _with("panel_rows", _moving_average("PARTITION BY permco, ticker", "end_date, headline")),
        "ma5_global": _with("panel_rows", _moving_average("", "permco, ticker, end_date, headline")),
        "token_counts": f"""
            WITH t AS (SELECT lang, unnest({_DOC_WORDS}) token FROM documents),
            c AS (SELECT lang, token, count(*) n FROM t WHERE token NOT IN ({_STOP}) GROUP BY ALL)
            SELECT lang, token, n FROM c
            UNION ALL SELECT '(all)', token, CAST(sum(n) AS BIGINT) FROM c GROUP BY token""",
        "top_tokens": _with("panel", f"""
            , t AS (SELECT ticker, unnest({_WORDS.format('headline')}) token FROM panel WHERE headline <> 'No_Headlines'),
            c AS (SELECT ticker, token, count(*) n FROM t WHERE token NOT IN ({_STOP}) GROUP BY ALL),
            a AS (SELECT ticker, token, n FROM c UNION ALL SELECT '(all)', token, CAST(sum(n) AS BIGINT) FROM c GROUP BY token),
            r AS (SELECT *, CAST(row_number() OVER (PARTITION BY ticker ORDER BY n DESC, token) AS INT) rank FROM a)
            SELECT * FROM r WHERE rank <= 10"""),
        "doc_term_counts": f"""
            WITH t AS (SELECT doc_id, unnest({_DOC_WORDS}) token FROM documents)
            SELECT doc_id, token, count(*) n FROM t WHERE token NOT IN ({_STOP}) GROUP BY ALL""",
        "headline_text": _with("news_linked", """
            , p AS (SELECT concat('T', CAST(permco AS VARCHAR)) ticker, headline,
                           row_number() OVER (PARTITION BY permco ORDER BY headline, keydevid) pos FROM news_linked)
            SELECT ticker, CAST((pos - 1) // 100 AS INT) part, string_agg(headline, ' ' ORDER BY pos) "text" FROM p GROUP BY ALL"""),
        "token_sequences": f"""
            WITH d AS (SELECT doc_id, {_DOC_WORDS} w FROM documents),
            s AS (SELECT doc_id, w, CAST(unnest(range(0, greatest(CAST(ceil(len(w) / 512) AS INT), 1))) AS INT) seq_no FROM d),
            q AS (SELECT doc_id, seq_no, w[seq_no * 512 + 1 : seq_no * 512 + 512] tk FROM s),
            b AS (SELECT *, (row_number() OVER (ORDER BY doc_id, seq_no) - 1) // 16 batch_no, CAST(len(tk) AS INT) n_tokens FROM q),
            p AS (SELECT *, max(n_tokens) OVER (PARTITION BY batch_no) width FROM b)
            SELECT doc_id, seq_no, batch_no, n_tokens, width,
                   array_to_string(tk, ' ') || repeat(' ', width - greatest(n_tokens, 1)) tokens,
                   repeat('1', n_tokens) || repeat('0', width - n_tokens) mask FROM p""",
        "hash_embedding": _EMBEDDING,
        "embed_with_udf": _EMBEDDING,
        "parse_vectors": """
            SELECT vec_id, CAST(generate_subscripts(embedding, 1) - 1 AS INT) place,
                   CAST(unnest(embedding) AS DOUBLE) AS value FROM embeddings""",
        "argmax_label": "SELECT vec_id, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) best FROM embeddings",
        "binary_metrics": _with("metrics", f"""SELECT permco, CAST("year" AS INT) AS "year", model, tn, fp, fn, tp, {_RATE_COLUMNS} FROM metrics"""),
        "confusion_matrix": _with("predictions", f"""
            SELECT permco, model, concat('[[', tn, ',', fp, '],[', fn, ',', tp, ']]') matrix
            FROM (SELECT permco, model, {_METRICS} FROM predictions GROUP BY ALL)"""),
        "error_by_model": _with("predictions", f"""
            SELECT model, {_r('avg(pow(true_direction - predicted_direction, 2))', name='mse')},
                   {_r('sqrt(avg(pow(true_direction - predicted_direction, 2)))', name='rmse')},
                   {_r('avg(abs(true_direction - predicted_direction))', name='mae')} FROM predictions GROUP BY model"""),
        "metrics_by_year": _with("metrics", f"""
            SELECT model, CAST("year" AS INT) AS "year", {_r('avg(accuracy)', name='accuracy')},
                   {_r('avg("precision")', name='"precision"')}, {_r('avg(recall)', name='recall')}, {_r('avg(f1)', name='f1')}
            FROM metrics GROUP BY ALL"""),
        "metrics_long": _with("metrics", _union([
            f"""SELECT permco, CAST("year" AS INT) AS "year", model, '{m}' metric, {_q(f'"{m}"')} AS value FROM metrics"""
            for m in ("accuracy", "precision", "recall", "f1")])),
        "metric_grid": _with("metrics", f"""
            SELECT g.permco, CAST(g."year" AS INT) AS "year", g.model, {_RATE_COLUMNS}
            FROM (SELECT DISTINCT permco, "year", x.model FROM metrics,
                    (VALUES ('momentum'), ('reversal'), ('trend'), ('absent')) x(model)) g
            LEFT JOIN metrics m ON m.permco = g.permco AND m."year" = g."year" AND m.model = g.model"""),
        "best_model_by_year": _with("metrics", f"""
            SELECT CAST("year" AS INT) AS "year", best_model, {_r('accuracy')} FROM ({_best('"year"')})"""),
        "best_model_by_company": _with("metrics", f"SELECT permco, best_model, {_r('accuracy')} FROM ({_best('permco')})"),
        "best_model_overall": _with("metrics", f"""
            SELECT model best_model, {_r('accuracy')} FROM
              (SELECT model, avg(accuracy) accuracy FROM
                 (SELECT "year", model, avg(accuracy) accuracy FROM metrics GROUP BY ALL) GROUP BY model
               ORDER BY accuracy DESC, model LIMIT 1)"""),
        "best_model_share": _with("metrics", f"""
            SELECT best_model, count(*) wins, round(count(*) * 100.0 / sum(count(*)) OVER (), 1) + 0.0 AS share_pct
            FROM ({_best('permco')}) GROUP BY best_model"""),
        "metrics_per_year": _with("predictions", f"""
            SELECT y.permco, y.model, CAST(y."year" AS INT) AS "year", tn, fp, fn, tp, {_RATE_COLUMNS}
            FROM (SELECT DISTINCT permco, model, "year" FROM predictions) y
            JOIN (SELECT *, {_RATES} FROM (SELECT permco, model, {_METRICS} FROM predictions GROUP BY ALL)) m
              ON m.permco = y.permco AND m.model = y.model"""),
        "metrics_per_year_true": _with("metrics", f"""SELECT permco, model, CAST("year" AS INT) AS "year", tn, fp, fn, tp, {_RATE_COLUMNS} FROM metrics"""),
        "flatten_structs": _with("metrics", f"""
            SELECT permco, CAST("year" AS INT) AS "year", model, {_r('accuracy', name='metrics_accuracy')}, {_r('f1', name='metrics_f1')},
                   tn metrics_counts_tn, fp metrics_counts_fp, fn metrics_counts_fn, tp metrics_counts_tp FROM metrics"""),
        "size_class": _with("all_sizes", f"""
            SELECT date, ticker, rec_id, rec_line, {_r('cap', 4)}, {_r('median_cap', 4)}, size_class FROM all_sizes"""),
        "period_return": _with("period_returns", f"SELECT ticker, start_date, {_r('price')}, {_r('ret')} FROM period_returns"),
        "cost_adjusted_returns": _with("net", f"""
            SELECT ticker, start_date, {_r('ret')}, size_class, {_r('cost')}, {_r('net_ret')} FROM net"""),
        "weekly_compound": _with("weekly_ret", f"SELECT week, ticker, {_r('ret')}, {_r('net_ret')} FROM weekly_ret"),
        "weekly_compound_row_cost": _with("later_bars sizes news_linked", f"""
            , rows_ AS (SELECT DISTINCT b.permco, b.ticker, b.start_date, b.adj_prc, coalesce(n.headline, 'No_Headlines') headline
                        FROM later_bars b LEFT JOIN news_linked n
                          ON b.permco = n.permco AND b.end_date = {_friday('n.announcedate')} + 7),
            r AS (SELECT *, adj_prc / lag(adj_prc) OVER (PARTITION BY ticker ORDER BY start_date, headline) - 1 ret FROM rows_),
            c AS (SELECT r.ticker, start_date, ret,
                         CASE WHEN size_class = 'Large' THEN {LARGE_COST!r} ELSE {SMALL_COST!r} END AS cost
                  FROM r LEFT JOIN sizes s ON s.date = start_date AND s.ticker = r.ticker WHERE ret IS NOT NULL)
            SELECT CAST(date_trunc('week', start_date) AS DATE) AS week, ticker, {_r('product(1 + ret) - 1', name='ret')},
                   {_r('product(1 + ret - cost) - 1', name='net_ret')} FROM c GROUP BY ALL"""),
        "market_return": _with("scenario_ret", f"SELECT scenario, week, {_r('avg(ret)', name='ret')} FROM scenario_ret GROUP BY ALL"),
        "returns_matrix": _matrix("ret"),
        "returns_matrix_net": _matrix("net_ret"),
        "ticker_scores": _with("scores", f"SELECT model, ticker, {_r('score')} FROM scores"),
        "long_short_picks": _with("picks", f"SELECT model, ticker, {_r('score')}, CAST(leg_rank AS INT) leg_rank, leg FROM picks"),
        "portfolio_weights": _with("weights", f"""
            SELECT model, ticker, {_r('score')}, CAST(leg_rank AS INT) leg_rank, leg, {_r('ew')}, {_r('vw')} FROM weights"""),
        "portfolio_returns": _with("series", f"SELECT model, scenario, week, type, {_r('ret')} FROM series"),
        "cumulative_returns": _with("series", """
            SELECT model, scenario, week, type,
                   CAST(printf('%.5e', product(1 + ret) OVER (PARTITION BY model, scenario, type ORDER BY week) - 1) AS DOUBLE) cum_ret
            FROM series"""),
        "risk_table": _with("risk", f"SELECT model, scenario, type, {_r('ret')}, {_r('std')}, {_r('sr')} FROM risk"),
        "risk_table_wide": _with("risk", f"""SELECT scenario "Scenario", type "Type", {_CELLS} FROM risk GROUP BY ALL ORDER BY 1, 2"""),
        "sharpe_by_model": _with("risk weekly_ret", """
            SELECT model, """ + ", ".join(
                _q(f"max(sr) FILTER (type = '{t}')") + f" AS {t.lower().replace(' ', '_')}"
                for t in ("EW L", "EW S", "EW LS", "VW L", "VW S", "VW LS")) + ", " + _q(
                "(SELECT avg(m) / nullif(stddev_samp(m), 0) FROM (SELECT avg(ret) m FROM weekly_ret GROUP BY week))") + """ AS market
            FROM risk WHERE scenario = 'Without Transaction Cost' GROUP BY model"""),
        "market_cumulative": _with("scenario_ret", """
            , m AS (SELECT scenario, week, avg(ret) ret FROM scenario_ret GROUP BY ALL)
            SELECT scenario, week, CAST(printf('%.5e', product(1 + ret) OVER (PARTITION BY scenario ORDER BY week) - 1) AS DOUBLE) cum_ret
            FROM m"""),
        "headline_vectors": _with("news_linked", f"""
            , h AS (SELECT DISTINCT headline, {_WORDS.format('headline')} w FROM news_linked),
            v AS (SELECT headline, 'uni16' model, 16 width, w terms FROM h
                  UNION ALL SELECT headline, 'uni32', 32, w FROM h
                  UNION ALL SELECT headline, 'pair32', 32,
                                   w || [w[i] || ' ' || w[i + 1] for i in range(1, greatest(len(w), 1))] FROM h),
            e AS (SELECT headline, model, len(terms) total,
                         unnest([CAST('0x' || substr(md5(t), 1, 8) AS BIGINT) % width for t in terms]) bucket FROM v)
            SELECT headline, model, CAST(bucket AS INT) bucket, {_q('count(*) / total')} AS value
            FROM e GROUP BY headline, model, bucket, total"""),
        "walk_forward_folds": _with("clean_rows", """
            , u AS (SELECT permco, CAST(year(start_date) * 4 + quarter(start_date) - 1 AS BIGINT) unit, count(*) n, sum(direction) up
                    FROM clean_rows GROUP BY ALL),
            p AS (SELECT permco, unit test_unit, n n_test, row_number() OVER k place, count(*) OVER (PARTITION BY permco) units,
                         string_agg(CAST(unit AS VARCHAR), ' ') OVER (k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) train_units,
                         CAST(sum(n) OVER (k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS BIGINT) n_train,
                         CAST(sum(up) OVER (k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS BIGINT) n_train_up
                  FROM u WINDOW k AS (PARTITION BY permco ORDER BY unit))
            SELECT permco, test_unit, n_test, train_units, n_train, n_train_up FROM p WHERE place > 10 AND place < units"""),
        "walk_forward_folds_years": """
            WITH u AS (SELECT vec_id % 2 permco, CAST(2005 + vec_id % 19 AS BIGINT) unit, count(*) n, sum(CASE WHEN label >= 5 THEN 1 ELSE 0 END) up
                       FROM embeddings GROUP BY ALL),
            p AS (SELECT permco, unit test_unit, n n_test, row_number() OVER k place, count(*) OVER (PARTITION BY permco) units,
                         string_agg(CAST(unit AS VARCHAR), ' ') OVER (k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) train_units,
                         CAST(sum(n) OVER (k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS BIGINT) n_train,
                         CAST(sum(up) OVER (k ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS BIGINT) n_train_up
                  FROM u WINDOW k AS (PARTITION BY permco ORDER BY unit))
            SELECT permco, test_unit, n_test, train_units, n_train, n_train_up FROM p WHERE place > 10 AND place < units""",
        "walk_forward_counts": _with("clean_rows", """
            , u AS (SELECT permco, CAST(year(start_date) * 4 + quarter(start_date) - 1 AS BIGINT) unit, count(*) n,
                           CAST(sum(direction) AS BIGINT) n_up FROM clean_rows GROUP BY ALL),
            p AS (SELECT *, row_number() OVER (PARTITION BY permco ORDER BY unit) place, count(*) OVER (PARTITION BY permco) units FROM u)
            SELECT permco, model, unit, n, n_up FROM p, (VALUES ('uni16'), ('uni32'), ('pair32')) m(model)
            WHERE place > 10 AND place < units"""),
        "train_predict_counts": _with("clean_rows", """
            SELECT permco, model, count(*) n, CAST(sum(direction) AS BIGINT) n_up
            FROM clean_rows, (VALUES ('uni16'), ('uni32'), ('pair32')) m(model)
            WHERE period = 'out_of_sample' AND permco IN (SELECT permco FROM clean_rows WHERE period = 'estimation')
            GROUP BY ALL"""),
        "lr_gradient": """
            SELECT permco, model, CAST(term AS INT) term, 0.0::DOUBLE gradient
            FROM (SELECT DISTINCT vec_id % 2 permco FROM embeddings), (VALUES ('first32'), ('last32')) m(model), range(0, 33) t(term)""",
        "lr_fit": f"""
            WITH RECURSIVE both_ AS (
                SELECT vec_id % 2 permco, m.model, CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS DOUBLE) y,
                       list_append(CAST(CASE m.model WHEN 'first32' THEN embedding[1:32] ELSE embedding[33:64] END AS DOUBLE[]), 1.0) x
                FROM embeddings, (VALUES ('first32'), ('last32')) m(model)),
            problems AS MATERIALIZED (
                SELECT struct_pack(permco := permco, model := model) id, list(struct_pack(x := x, y := y)) rows FROM both_ GROUP BY permco, model),
            {_descent(1500)}
            SELECT id.permco permco, id.model model, CAST(generate_subscripts(w, 1) - 1 AS INT) term, {_q('unnest(w)')} AS coefficient
            FROM d WHERE pass = 1500""",
        "walk_forward_years": f"""
            WITH RECURSIVE v AS MATERIALIZED (
                SELECT vec_id, vec_id % 2 permco, m.model, CAST(2005 + vec_id % 19 AS BIGINT) unit, CAST(CASE WHEN label >= 5 THEN 1 ELSE 0 END AS INT) y,
                       list_append(CAST(CASE m.model WHEN 'first16' THEN embedding[1:16] ELSE embedding[49:64] END AS DOUBLE[]), 1.0) x
                FROM embeddings, (VALUES ('first16'), ('last16')) m(model)),
            u AS (SELECT permco, unit, row_number() OVER (PARTITION BY permco ORDER BY unit) place, count(*) OVER (PARTITION BY permco) units
                  FROM (SELECT DISTINCT permco, unit FROM v)),
            f AS (SELECT t.permco, t.unit test_unit, o.unit FROM u t JOIN u o ON o.permco = t.permco AND o.place BETWEEN t.place - 10 AND t.place - 1
                  WHERE t.place > 10 AND t.place < t.units),
            problems AS MATERIALIZED (
                SELECT struct_pack(permco := v.permco, model := model, unit := test_unit) id, list(struct_pack(x := x, y := CAST(y AS DOUBLE))) rows
                FROM v JOIN f ON f.permco = v.permco AND f.unit = v.unit GROUP BY v.permco, model, test_unit),
            {_descent(400)}
            SELECT v.permco, v.model, vec_id, v.unit, y true_direction, CAST(CASE WHEN list_dot_product(w, x) > 0 THEN 1 ELSE 0 END AS INT) predicted_direction,
                   false one_class, 'converged' status
            FROM d JOIN v ON id.permco = v.permco AND id.model = v.model AND id.unit = v.unit WHERE pass = 400""",
        "trained_values": f"""{_TRAINED}
            SELECT permco, vec_id, CAST(y AS INT) true_direction, CAST(CASE WHEN list_dot_product(w1, x) > list_dot_product(w0, x) THEN 1 ELSE 0 END AS INT) predicted_direction,
                   {_q('list_dot_product(w0, x)')} AS down, {_q('list_dot_product(w1, x)')} AS up FROM vectors JOIN mean3 USING (permco) WHERE vec_id % 5 >= 3""",
        "trained_steps": _TRAINED + " UNION ALL ".join(
            f"SELECT permco, 'loss' kind, {e} epoch, CAST(shard AS INT) shard, CAST(step AS INT) step, {_q('loss')} AS value FROM s{e} WHERE step > 0 UNION ALL {_accuracy(e)}"
            for e in (1, 2, 3)),
        "lr_gradient_wide": """
            SELECT permco, 'converged' status, CAST(term AS INT) term, 0.0::DOUBLE gradient
            FROM (SELECT DISTINCT vec_id % 2 permco FROM embeddings), range(0, 129) t(term)""",
        "lr_status": """
            SELECT DISTINCT vec_id % 5 permco, CASE vec_id % 5 WHEN 3 THEN 'missing_values' WHEN 4 THEN 'one_class' ELSE 'converged' END status,
                   CAST(CASE WHEN vec_id % 5 >= 3 THEN 0 ELSE 65 END AS INT) n_terms FROM embeddings""",
        "predictions_of_company": _with("predictions", """
            SELECT permco, model, ticker, end_date, true_direction, predicted_direction FROM predictions WHERE permco = 7"""),
        "predictions_of_model": _with("predictions", """
            SELECT permco, model, ticker, end_date, true_direction, predicted_direction FROM predictions WHERE model = 'trend'"""),
        "sketch_counts": _with("panel_daily", f"""
            , d AS (SELECT unnest(['prc', 'ret', 'market_cap']) column_name, unnest([prc, ret, prc * shrout]) v FROM panel_daily)
            SELECT column_name, count(v) n, {_r('min(v)', 3, '"min"')}, {_r('max(v)', 3, '"max"')}, true q25_close, true q50_close, true q75_close
            FROM d GROUP BY ALL"""),
        "validated_panel": _with("clean_rows", f"""
            SELECT permco "Permco", ticker "Ticker", start_date "Start_Date", end_date "End_Date", {_r('weekly_ret', name='"Weekly_Return"')},
                   {_r('adj_prc', name='"Adjusted_Price"')}, headline "Headline", direction "Direction" FROM clean_rows WHERE period = 'estimation'"""),
        "doc_vectors": f"""
            WITH words AS (SELECT doc_id, unnest({_DOC_WORDS}) w FROM documents),
            t AS (SELECT doc_id, w, count(*) n FROM words WHERE w NOT IN ({_STOP}) GROUP BY ALL),
            v AS (SELECT w, row_number() OVER (ORDER BY count(*) DESC, w) - 1 place FROM t GROUP BY w HAVING count(*) >= 2)
            SELECT doc_id, string_agg(CAST(place AS VARCHAR), ' ' ORDER BY place) indices, string_agg(CAST(n AS VARCHAR), ' ' ORDER BY place) counts
            FROM t JOIN v USING (w) GROUP BY doc_id""",
        "embed_sequences": f"""
            WITH t AS (SELECT doc_id, unnest({_DOC_WORDS}) w, generate_subscripts({_DOC_WORDS}, 1) i FROM documents),
            d AS (SELECT doc_id, CAST(len({_DOC_WORDS}) AS BIGINT) n_tokens FROM documents),
            m AS (SELECT doc_id, avg(length(w)) a, avg((i - 1) % 512) b, avg(CAST('0x' || substr(md5(w), 1, 4) AS BIGINT) % 100) c FROM t GROUP BY doc_id)
            SELECT doc_id, n_tokens, {_r('a', name='"length"')}, {_r('b', name='place')}, {_r('c', name='"hash"')} FROM d LEFT JOIN m USING (doc_id)""",
        "word_pairs": f"{_PAIRS} SELECT a, b, n FROM pairs WHERE n >= 4",
        "word_information": f"""{_PAIRS},
            frequent AS (SELECT w FROM (SELECT unnest(w) w FROM lists) GROUP BY w HAVING count(*) >= 30),
            kept AS (SELECT * FROM pairs WHERE a IN (SELECT w FROM frequent) AND b IN (SELECT w FROM frequent)),
            both_ AS (SELECT a, b, n FROM kept UNION ALL SELECT b, a, n FROM kept WHERE a <> b),
            of AS (SELECT a, sum(n) s FROM both_ GROUP BY a),
            x AS (SELECT b.a, b.b, ln(b.n * (SELECT sum(s) FROM of)::DOUBLE / (p.s::DOUBLE * q.s)) weight FROM both_ b JOIN of p ON b.a = p.a JOIN of q ON b.b = q.a)
            SELECT a, b, {_r('weight')} FROM x WHERE weight > 0""",
        "train_predict_pooled": """
            SELECT lang, CAST(quality AS INT) AS label, count(*) n, count(*) n_scored FROM documents JOIN labels USING (doc_id)
            WHERE doc_id % 2 = 1 GROUP BY ALL""",
        "pooled_idf": f"{_POOLED} SELECT bucket, documents, {_r('idf')} FROM weights",
        "pooled_gradient": f"{_POOLED} SELECT bucket, 0.0::DOUBLE gradient FROM weights",
        "pooled_class": f"""{_POOLED}, m AS (
                SELECT doc_id, sum(n * coalesce(idf, 0) * ((bucket * 37 % 101 - 50) / 100.0::DOUBLE)) + 0.25 margin
                FROM cells LEFT JOIN weights USING (bucket) WHERE doc_id % 2 = 1 GROUP BY ALL)
            SELECT doc_id, {_r('margin')}, CAST(CASE WHEN margin > 0 THEN 1 ELSE 0 END AS INT) predicted FROM m""",
        "universe_panel": _with("period_panel", f"""
            , rows_ AS (SELECT DISTINCT period, permco, ticker, start_date, end_date, weekly_ret, adj_prc, headline, direction FROM period_panel)
            SELECT period, {_BAR}, headline, direction,
                   {_q("CASE WHEN count(adj_prc) OVER w = 5 THEN avg(adj_prc) OVER w END")} AS ma5
            FROM rows_ WINDOW w AS (PARTITION BY period, permco, ticker ORDER BY end_date, headline ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
            _chain_steps()),
        "universe_risk": _with("risk", f"SELECT model, scenario, type, {_r('ret')}, {_r('std')}, {_r('sr')} FROM risk", _chain_steps()),
        "trainable_groups": _with("period_bars", """
            SELECT permco FROM period_bars GROUP BY permco HAVING count(DISTINCT period) = 2"""),
    }
