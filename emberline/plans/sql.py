"""SQL text of the views and formulas, for the queries that the driver runs in another engine."""

from __future__ import annotations

from emberline.functions.fuels import CODES, FUELS, SCHEMES
from emberline.functions.fwi import DC_LENGTH, DMC_LENGTH
from emberline.sources.views import RASTER_CODES


def _list(values, quote: bool = False) -> str:
    return "[" + ", ".join(f"'{v}'" if quote else f"{v}" for v in values) + "]"


RAD = "0.017453292519943295::DOUBLE"
_KINDS = _list(("surface", "surface_with_torching", "passive_crown", "active_crown"), True)
VIEWS = {
    "v_obs": """SELECT user_id AS station, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS day, CAST(4 + user_id % 7 AS INTEGER) AS month,
  5.0::DOUBLE + CAST(event_id * 37 % 3000 AS DOUBLE) / 100.0::DOUBLE AS temp, 10.0::DOUBLE + CAST(event_id * 53 % 8500 AS DOUBLE) / 100.0::DOUBLE AS rh,
  value - 60.0::DOUBLE * floor(value / 60.0::DOUBLE) AS wind, CASE WHEN event_type = 'error' THEN CAST(event_id * 29 % 400 AS DOUBLE) / 10.0::DOUBLE ELSE 0.0::DOUBLE END AS rain,
  ts, value, event_type AS kind, event_id FROM events""",
    "v_scen": f"""SELECT o_orderkey AS scen, {_list(CODES, True)}[CAST(o_orderkey % 18 + 1 AS INTEGER)] AS fuel, CAST(o_orderkey * 7 % 600 AS DOUBLE) / 10.0::DOUBLE AS wind, CAST(o_orderkey * 11 % 360 AS DOUBLE) AS dir,
  70.0::DOUBLE + CAST(o_custkey * 13 % 300 AS DOUBLE) / 10.0::DOUBLE AS ffmc, o_totalprice - 150.0::DOUBLE * floor(o_totalprice / 150.0::DOUBLE) AS dmc, CAST(o_orderkey * 31 % 8000 AS DOUBLE) / 10.0::DOUBLE AS dc,
  CAST(o_orderkey % 9 AS DOUBLE) * 10.0::DOUBLE AS slope, CAST(o_orderkey % 101 AS DOUBLE) AS pc, 50.0::DOUBLE + CAST(o_orderkey % 51 AS DOUBLE) AS cure FROM orders""",
    "v_asset": """SELECT c_custkey AS asset, 53.3::DOUBLE + CAST(c_custkey * 7919 % 5000 AS DOUBLE) / 10000.0::DOUBLE AS lat, -113.8::DOUBLE + CAST(c_custkey * 104729 % 6000 AS DOUBLE) / 10000.0::DOUBLE AS lng, c_mktsegment AS layer, c_name AS name FROM customer""",
    "v_station": """SELECT s_suppkey AS station, 53.3::DOUBLE + CAST(s_suppkey * 6101 % 5000 AS DOUBLE) / 10000.0::DOUBLE AS slat, -113.8::DOUBLE + CAST(s_suppkey * 9973 % 6000 AS DOUBLE) / 10000.0::DOUBLE AS slng, s_acctbal AS reading FROM supplier""",
    "v_zone": """SELECT n_nationkey AS zone, n_name AS zone_name, 53.3::DOUBLE + CAST(n_nationkey // 5 AS DOUBLE) * 0.1::DOUBLE AS lat0, -113.8::DOUBLE + CAST(n_nationkey % 5 AS DOUBLE) * 0.12::DOUBLE AS lng0,
  0.8::DOUBLE + 0.1::DOUBLE * n_regionkey AS ros_mult, 0.9::DOUBLE + 0.1::DOUBLE * n_regionkey AS int_mult, 1.0::DOUBLE + 0.25::DOUBLE * n_regionkey AS ember_mult FROM nation""",
    "v_cell": f"""SELECT CAST(p_partkey // 40 AS INTEGER) AS row, CAST(p_partkey % 40 AS INTEGER) AS col, {_list(RASTER_CODES)}[CAST(p_size % 9 + 1 AS INTEGER)] AS code, p_retailprice AS elev FROM part""",
    "v_frame": f"""SELECT station AS sim, CAST(day - 1 AS INTEGER) AS idx, (day - 1) * 0.5::DOUBLE AS t, wind * 0.5::DOUBLE AS ros, value * 20.0::DOUBLE AS hfi, {_KINDS}[CAST(floor(value) AS BIGINT) % 4 + 1] AS fire_type,
  53.55::DOUBLE + CAST(station AS DOUBLE) * 0.0001::DOUBLE AS lat, -113.5::DOUBLE AS lng, 30.0::DOUBLE + 40.0::DOUBLE * (day - 1) AS radius, event_id, kind FROM v_obs""",
    "v_spot": """SELECT sim, idx, t, 53.5::DOUBLE + CAST(event_id * 17 % 50 AS DOUBLE) / 1000.0::DOUBLE AS lat, -113.5::DOUBLE + CAST(event_id * 23 % 40 AS DOUBLE) / 1000.0::DOUBLE AS lng, lat AS src_lat, lng AS src_lng,
  10.0::DOUBLE + CAST(event_id * 41 % 900 AS DOUBLE) AS distance, hfi FROM v_frame WHERE kind = 'error'""",
    "v_prob": "SELECT row, col, CAST(CAST(floor(elev * 10) AS BIGINT) % 101 AS DOUBLE) / 100.0::DOUBLE AS p FROM v_cell",
    "fuels": "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else f"{x}::DOUBLE" for x in f) + ")" for f in FUELS) + ") AS f(fuel, fuel_group, a, b, c, q, bui0, cbh, cfl, sfc, cbd)",
    "codes": "SELECT * FROM (VALUES " + ", ".join(f"('{s}', {k}, '{v}')" for s, m in SCHEMES.items() for k, v in m.items()) + ") AS k(scheme, code, fuel)",
}
_NEEDS = {"v_frame": ["v_obs"], "v_spot": ["v_obs", "v_frame"], "v_prob": ["v_cell"]}


def query(views: str, body: str) -> str:
    """A statement over the named views. body goes on with further common tables or is the SELECT itself."""
    names: list[str] = []
    for v in views.split():
        names += [x for x in [*_NEEDS.get(v, []), v] if x not in names]
    head = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in names)
    body = body.strip()
    return f"WITH RECURSIVE {head}{',' if body.lower().startswith('with ') else ''}\n{body[5:] if body.lower().startswith('with ') else body}"


def n(x: float) -> str:
    return f"{x!r}::DOUBLE"


def isi(f: str, w: str) -> str:
    m = f"(147.2::DOUBLE * (101.0::DOUBLE - {f}) / (59.5::DOUBLE + {f}))"
    return f"(0.208::DOUBLE * exp(0.05039::DOUBLE * {w}) * 91.9::DOUBLE * exp(-0.1386::DOUBLE * {m}) * (1.0::DOUBLE + pow({m}, 5.31::DOUBLE) / 4.93e7::DOUBLE))"


def bui(dmc: str, dc: str) -> str:
    u = f"({dmc} + 0.4::DOUBLE * {dc})"
    return f"(CASE WHEN {u} = 0 THEN 0.0::DOUBLE WHEN {dmc} <= 0.4::DOUBLE * {dc} THEN greatest(0.0::DOUBLE, 0.8::DOUBLE * {dmc} * {dc} / nullif({u}, 0)) ELSE greatest(0.0::DOUBLE, {dmc} - (1.0::DOUBLE - 0.8::DOUBLE * {dc} / nullif({u}, 0)) * (0.92::DOUBLE + pow(0.0114::DOUBLE * {dmc}, 1.7::DOUBLE))) END)"


def fwi(i: str, b: str) -> str:
    f = f"(CASE WHEN {b} <= 80 THEN 0.626::DOUBLE * pow({b}, 0.809::DOUBLE) + 2.0::DOUBLE ELSE 1000.0::DOUBLE / (25.0::DOUBLE + 108.64::DOUBLE * exp(-0.023::DOUBLE * {b})) END)"
    x = f"(0.1::DOUBLE * {i} * {f})"
    return f"(CASE WHEN {x} <= 1 THEN {x} ELSE exp(2.72::DOUBLE * pow(0.434::DOUBLE * ln(greatest({x}, 1.0::DOUBLE)), 0.647::DOUBLE)) END)"


def ffmc(t: str, h: str, w: str, r: str, f: str) -> str:
    mo = f"(147.2::DOUBLE * (101.0::DOUBLE - {f}) / (59.5::DOUBLE + {f}))"
    rf = f"greatest({r} - 0.5::DOUBLE, 1e-9::DOUBLE)"
    wet = f"({mo} + 42.5::DOUBLE * {rf} * exp(-100.0::DOUBLE / (251.0::DOUBLE - {mo})) * (1.0::DOUBLE - exp(-6.93::DOUBLE / {rf})) + CASE WHEN {mo} > 150 THEN 0.0015::DOUBLE * ({mo} - 150.0::DOUBLE) * ({mo} - 150.0::DOUBLE) * sqrt({rf}) ELSE 0.0::DOUBLE END)"
    return f"(CASE WHEN {r} > 0.5 THEN least({wet}, 250.0::DOUBLE) ELSE {mo} END)"


def ffmc_of_moisture(t: str, h: str, w: str, mo: str) -> str:
    """The code after drying or wetting from a moisture that stands in a column."""
    heat = f"0.18::DOUBLE * (21.1::DOUBLE - {t}) * (1.0::DOUBLE - 1.0::DOUBLE / exp(0.115::DOUBLE * {h}))"
    ed = f"(0.942::DOUBLE * pow({h}, 0.679::DOUBLE) + 11.0::DOUBLE * exp(({h} - 100.0::DOUBLE) / 10.0::DOUBLE) + {heat})"
    ew = f"(0.618::DOUBLE * pow({h}, 0.753::DOUBLE) + 10.0::DOUBLE * exp(({h} - 100.0::DOUBLE) / 10.0::DOUBLE) + {heat})"

    def rate(s: str) -> str:
        return f"((0.424::DOUBLE * (1.0::DOUBLE - pow({s}, 1.7::DOUBLE)) + 0.0694::DOUBLE * sqrt({w}) * (1.0::DOUBLE - pow({s}, 8.0::DOUBLE))) * 0.581::DOUBLE * exp(0.0365::DOUBLE * {t}))"

    dry, wet = rate(f"({h} / 100.0::DOUBLE)"), rate(f"((100.0::DOUBLE - {h}) / 100.0::DOUBLE)")
    m = f"(CASE WHEN {mo} > {ed} THEN {ed} + ({mo} - {ed}) * pow(10.0::DOUBLE, -{dry}) WHEN {mo} < {ew} THEN {ew} - ({ew} - {mo}) * pow(10.0::DOUBLE, -{wet}) ELSE {mo} END)"
    return f"greatest(0.0::DOUBLE, least(101.0::DOUBLE, 59.5::DOUBLE * (250.0::DOUBLE - {m}) / (147.2::DOUBLE + {m})))"


def dmc(t: str, h: str, r: str, month: str, p: str) -> str:
    re = f"(0.92::DOUBLE * {r} - 1.27::DOUBLE)"
    b = f"(CASE WHEN {p} <= 33 THEN 100.0::DOUBLE / (0.5::DOUBLE + 0.3::DOUBLE * {p}) WHEN {p} <= 65 THEN 14.0::DOUBLE - 1.3::DOUBLE * ln(greatest({p}, 1e-9::DOUBLE)) ELSE 6.2::DOUBLE * ln(greatest({p}, 1e-9::DOUBLE)) - 17.2::DOUBLE END)"
    mr = f"(20.0::DOUBLE + exp(5.6348::DOUBLE - {p} / 43.43::DOUBLE) + 1000.0::DOUBLE * {re} / (48.77::DOUBLE + {b} * {re}))"
    held = f"(CASE WHEN {r} > 1.5 THEN greatest(0.0::DOUBLE, 244.72::DOUBLE - 43.43::DOUBLE * ln({mr} - 20.0::DOUBLE)) ELSE {p} END)"
    k = f"(CASE WHEN {t} > -1.1 THEN 1.894::DOUBLE * ({t} + 1.1::DOUBLE) * (100.0::DOUBLE - {h}) * CAST({_list(DMC_LENGTH)}[{month}] AS DOUBLE) * 1e-4::DOUBLE ELSE 0.0::DOUBLE END)"
    return f"greatest(0.0::DOUBLE, {held} + {k})"


def dc(t: str, r: str, month: str, p: str) -> str:
    qr = f"(800.0::DOUBLE * exp(-({p}) / 400.0::DOUBLE) + 3.937::DOUBLE * (0.83::DOUBLE * {r} - 1.27::DOUBLE))"
    held = f"(CASE WHEN {r} > 2.8 THEN greatest(0.0::DOUBLE, 400.0::DOUBLE * ln(800.0::DOUBLE / {qr})) ELSE {p} END)"
    v = f"(CASE WHEN {t} > -2.8 THEN greatest(0.0::DOUBLE, 0.36::DOUBLE * ({t} + 2.8::DOUBLE) + CAST({_list(DC_LENGTH)}[{month}] AS DOUBLE)) ELSE 0.0::DOUBLE END)"
    return f"greatest(0.0::DOUBLE, {held} + 0.5::DOUBLE * {v})"


def bui_effect(b: str, q: str, b0: str) -> str:
    return f"(CASE WHEN {b} <= 0 OR {q} >= 1 THEN 1.0::DOUBLE ELSE exp(50.0::DOUBLE * ln({q}) * (1.0::DOUBLE / nullif({b}, 0) - 1.0::DOUBLE / {b0})) END)"


def curing(c: str) -> str:
    d = f"({c} - 58.8::DOUBLE)"
    return f"greatest(0.0::DOUBLE, least(1.0::DOUBLE, CASE WHEN {d} < 0 THEN 0.176::DOUBLE + 0.020::DOUBLE * {d} ELSE 0.176::DOUBLE + 0.020::DOUBLE * {d} * (1.0::DOUBLE - 0.008::DOUBLE * {d}) END))"


def surface_ros(i: str = "isi", b: str = "bui") -> str:
    """Of a row joined with its fuel."""
    con = f"(110.0::DOUBLE * pow(1.0::DOUBLE - exp(-0.0282::DOUBLE * {i}), 1.5::DOUBLE) * {bui_effect(b, '0.7::DOUBLE', '64.0::DOUBLE')})"
    leaf = f"(30.0::DOUBLE * pow(1.0::DOUBLE - exp(-0.0232::DOUBLE * {i}), 1.6::DOUBLE) * CASE WHEN fuel = 'M2' THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END)"
    plain = f"(a * pow(1.0::DOUBLE - exp(-b * {i}), c) * CASE WHEN fuel_group IN ('conifer', 'slash', 'mixedwood') THEN {bui_effect(b, 'q', 'bui0')} ELSE 1.0::DOUBLE END * CASE WHEN fuel IN ('O1a', 'O1b') THEN {curing('cure')} ELSE 1.0::DOUBLE END)"
    return f"(CASE WHEN fuel IN ('M1', 'M2') THEN pc / 100.0::DOUBLE * {con} + (1.0::DOUBLE - pc / 100.0::DOUBLE) * {leaf} ELSE {plain} END)"


def slope_factor(s: str) -> str:
    return f"(CASE WHEN {s} > 0 THEN least(exp(3.533::DOUBLE * pow({s} / 100.0::DOUBLE, 1.2::DOUBLE)), 2.0::DOUBLE) ELSE 1.0::DOUBLE END)"


def directional_slope(s: str, aspect: str, bearing: str) -> str:
    d = f"abs({bearing} - {aspect})"
    c = f"cos((CASE WHEN {d} > 180 THEN 360.0::DOUBLE - {d} ELSE {d} END) * {RAD})"
    return f"(CASE WHEN {s} < 1 THEN 1.0::DOUBLE WHEN {c} > 0 THEN 1.0::DOUBLE + (least(exp(3.533::DOUBLE * pow({s} / 100.0::DOUBLE, 1.2::DOUBLE)), 2.0::DOUBLE) - 1.0::DOUBLE) * {c} ELSE 1.0::DOUBLE - 0.3::DOUBLE * abs({c}) END)"


def lbr(w: str) -> str:
    return f"(CASE WHEN {w} <= 0 THEN 1.0::DOUBLE ELSE 1.0::DOUBLE + 8.729::DOUBLE * pow(1.0::DOUBLE - exp(-0.030::DOUBLE * {w}), 2.155::DOUBLE) END)"


def spread_prob(angle: str, bearing: str, ros: str, l: str, cell: str, dt: str) -> str:
    m = f"((({angle} - {bearing}) % 360.0::DOUBLE + 360.0::DOUBLE) % 360.0::DOUBLE)"
    d = f"(CASE WHEN {m} > 180 THEN 360.0::DOUBLE - {m} ELSE {m} END)"
    return f"(CASE WHEN {ros} < 1e-10 THEN 0.0::DOUBLE ELSE least(1.0::DOUBLE, {ros} * pow(1.0::DOUBLE / ({l} * {l}), {d} / 180.0::DOUBLE) * {dt} / {cell}) END)"


def haversine(a: str, b: str, c: str, d: str) -> str:
    x = f"(pow(sin(({c} - {a}) * {RAD} / 2.0::DOUBLE), 2.0::DOUBLE) + cos({a} * {RAD}) * cos({c} * {RAD}) * pow(sin(({d} - {b}) * {RAD} / 2.0::DOUBLE), 2.0::DOUBLE))"
    return f"(2.0::DOUBLE * 6371.0::DOUBLE * asin(sqrt(least(1.0::DOUBLE, {x}))))"


#: Scenario rows with the whole fire behaviour, as the table ``fbp``; slope and fmc are expressions.
def fbp(slope: str = "slope", fmc: str = "100.0::DOUBLE", source: str = "v_scen") -> str:
    return f"""WITH w0 AS (SELECT s.*, {isi('s.ffmc', 's.wind')} AS isi, {bui('s.dmc', 's.dc')} AS bui FROM {source} s),
w1 AS (SELECT w0.*, fuels.* EXCLUDE (fuel) FROM w0 JOIN fuels ON w0.fuel = fuels.fuel),
w2 AS (SELECT *, {surface_ros()} * {slope_factor(slope)} AS ros_surface FROM w1),
w3 AS (SELECT *, 18000.0::DOUBLE * sfc * ros_surface / 60.0::DOUBLE AS sfi, CASE WHEN cbh <= 0 THEN 0.0::DOUBLE ELSE pow(0.01::DOUBLE * cbh * (460.0::DOUBLE + 25.9::DOUBLE * {fmc}), 1.5::DOUBLE) END AS csi FROM w2),
w4 AS (SELECT *, CASE WHEN csi <= 0 OR sfi < csi THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0::DOUBLE - sqrt(csi / nullif(sfi, 0)))) END AS cfb FROM w3),
w5 AS (SELECT *, CASE WHEN cfb >= 0.9 THEN 'active_crown' WHEN cfb > 0.1 THEN 'passive_crown' WHEN cfb > 0 THEN 'surface_with_torching' ELSE 'surface' END AS fire_type,
  ros_surface + cfb * (CASE WHEN cfb > 0 AND cbd >= 0.05 THEN ros_surface * least(1.0::DOUBLE + (cbd - 0.05::DOUBLE) / 0.1::DOUBLE, 3.0::DOUBLE) ELSE ros_surface END - ros_surface) AS ros_final, sfc + cfl * cfb AS tfc FROM w4),
w6 AS (SELECT *, 18000.0::DOUBLE * tfc * ros_final / 60.0::DOUBLE AS hfi FROM w5),
fbp AS (SELECT *, CASE WHEN hfi <= 0 THEN 0.0::DOUBLE ELSE 0.0775::DOUBLE * pow(hfi, 0.46::DOUBLE) END AS flame FROM w6)"""


N_ROWS = "(SELECT max(row) + 1 FROM v_cell)"


def cell(lat: str, lng: str) -> str:
    """Row and column of a place in the grid of v_cell."""
    row = f"CAST(least({N_ROWS} - 1, greatest(0, floor((53.8::DOUBLE - {lat}) / (53.8::DOUBLE - 53.3::DOUBLE) * {N_ROWS}))) AS INTEGER) AS row"
    return f"{row}, CAST(least(39, greatest(0, floor(({lng} - (-113.8::DOUBLE)) / (-113.2::DOUBLE - (-113.8::DOUBLE)) * 40))) AS INTEGER) AS col"
