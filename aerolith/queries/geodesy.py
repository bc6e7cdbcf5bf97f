"""Geodesy, projections and cameras."""

from __future__ import annotations

from math import radians

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from aerolith.functions import geodesy as g
from aerolith.functions.camera import Camera, pitched, rolled, screen, screen_single, transformed, zoomed
from aerolith.functions.geodesic_rows import direct_rows, inverse_rows
from aerolith.functions.projections import LambertConic, Stereographic, WebMercator
from aerolith.queries.common import A, B, E2, EP2, F_, PAIRS, POINTS, R1, bearing_sql, direct_sql, ecef_sql, hav_sql, pairs, points, rnd, rsql, table, wrap_sql

LCC = LambertConic(radians(33), radians(45), 0.0, radians(-96))
STEREO = Stereographic(radians(-23.5505), radians(-46.6333))
CAMERA = Camera(radians(-23.5505), radians(-46.6333), zoom=0.02, rotation=0.3, pitch=0.4, roll=0.1, aspect_ratio=4 / 3)
WIDTH, HEIGHT = 800.0, 600.0


def haversine_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pairs(spark, sf_dir).withColumn("g", g.haversine_inverse("lat1", "lon1", "lat2", "lon2"))
    return r.select("id", rnd("g.distance", 2).alias("distance"), rnd("g.initial_bearing", 8).alias("initial_bearing"), rnd("g.final_bearing", 8).alias("final_bearing"))


def haversine_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pairs(spark, sf_dir).withColumn("p", g.haversine_direct("lat1", "lon1", "height", "bearing", "distance"))
    return r.select("id", rnd("p.lat", 8).alias("lat"), rnd("p.lon", 8).alias("lon"), rnd("p.height", 2).alias("height"))


def vincenty_inverse(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pairs(spark, sf_dir).withColumn("g", g.vincenty_inverse("lat1", "lon1", "lat2", "lon2"))
    return r.select("id", rnd("g.distance", 2).alias("distance"), rnd("g.initial_bearing", 7).alias("initial_bearing"), rnd("g.final_bearing", 7).alias("final_bearing"))


def vincenty_direct(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pairs(spark, sf_dir).withColumn("p", g.vincenty_direct("lat1", "lon1", "height", "bearing", "distance"))
    return r.select("id", rnd("p.lat", 8).alias("lat"), rnd("p.lon", 8).alias("lon"), rnd("p.height", 2).alias("height"))


def vincenty_inverse_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The inverse problem in generated code; pairs that are nearly antipodal go through the batch solver."""
    r = inverse_rows(pairs(spark, sf_dir), "lat1", "lon1", "lat2", "lon2")
    return r.select("id", rnd("g.distance", 2).alias("distance"), rnd("g.initial_bearing", 7).alias("initial_bearing"), rnd("g.final_bearing", 7).alias("final_bearing"))


def vincenty_direct_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = direct_rows(pairs(spark, sf_dir), "lat1", "lon1", "height", "bearing", "distance")
    return r.select("id", rnd("p.lat", 8).alias("lat"), rnd("p.lon", 8).alias("lon"), rnd("p.height", 2).alias("height"))


def lla_ecef(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = points(spark, sf_dir).withColumn("p", g.lla_to_ecef("lat", "lon", "height"))
    return r.select("id", *(rnd(f"p.{c}", 2).alias(c) for c in "xyz"))


def ecef_lla(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = points(spark, sf_dir).select("id", g.lla_to_ecef("lat", "lon", "height").alias("p"))
    r = r.select("id", g.ecef_to_lla("p.x", "p.y", "p.z").alias("q"))
    return r.select("id", rnd("q.lat", 8).alias("lat"), rnd("q.lon", 8).alias("lon"), rnd("q.height", 2).alias("height"))


def lla_enu(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pairs(spark, sf_dir).withColumn("e", g.lla_to_enu("lat2", "lon2", F.lit(500.0), "lat1", "lon1", "height"))
    return r.select("id", *(rnd(f"e.{c}", 2).alias(c) for c in ("east", "north", "up")), rnd(g.distance_2d(F.col("e")), 2).alias("flat"), rnd(g.distance_3d(F.col("e")), 2).alias("slant"))


def enu_lla(spark: SparkSession, sf_dir: str) -> DataFrame:
    """There and back again: the oracle has the points themselves."""
    r = pairs(spark, sf_dir).withColumn("e", g.lla_to_enu("lat2", "lon2", F.lit(500.0), "lat1", "lon1", "height"))
    r = r.withColumn("q", g.enu_to_lla("e.east", "e.north", "e.up", "lat1", "lon1", "height"))
    return r.select("id", rnd("q.lat", 7).alias("lat"), rnd("q.lon", 7).alias("lon"), rnd("q.height", 2).alias("height"))


def chord_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = pairs(spark, sf_dir).select("id", g.lla_to_ecef("lat1", "lon1", "height").alias("p"), g.lla_to_ecef("lat2", "lon2", F.lit(0.0)).alias("q"))
    return r.select("id", rnd(g.chord_distance(F.col("p"), F.col("q")), 2).alias("chord"))


def normalize_angles(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = ((F.col("l_partkey") * 17 + F.col("l_orderkey") * 3) % 4001 - 2000).cast("double") / F.lit(100.0)
    keys = ("l_orderkey", "l_linenumber", "l_partkey")
    return table(spark, sf_dir, "lineitem").select(*keys, rnd(g.normalize_bearing(x), 8).alias("bearing"), rnd(g.normalize_longitude(x), 8).alias("longitude"))


def validate_coords(spark: SparkSession, sf_dir: str) -> DataFrame:
    lat, lon = (F.col("c_custkey") * 7 % 200 - 100).cast("double"), (F.col("c_custkey") * 11 % 400 - 200).cast("double")
    return table(spark, sf_dir, "customer").select("c_custkey", F.coalesce(g.position_error(F.radians(lat), F.radians(lon)), F.lit("ok")).alias("status"))


def _projected(p):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = points(spark, sf_dir).withColumn("p", p.project("lat", "lon"))
        return r.select("id", rnd("p.x", 1).alias("x"), rnd("p.y", 1).alias("y"))

    return run


def _returned(p):
    """Projected and brought back: the oracle has the points themselves."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = points(spark, sf_dir).withColumn("p", p.project("lat", "lon")).withColumn("q", p.unproject("p.x", "p.y"))
        lon = rnd("q.lon", 6)  # a hair below 180 degrees is the same meridian
        return r.select("id", rnd("q.lat", 6).alias("lat"), F.when(lon == 3.141593, -lon).otherwise(lon).alias("lon"))

    return run


def _screen(mode: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        r = points(spark, sf_dir).withColumn("s", screen("lat", "lon", "height", CAMERA, STEREO, WIDTH, HEIGHT, mode)).where("s is not null")
        return r.select("id", rnd("s.x", 3).alias("x"), rnd("s.y", 3).alias("y"))

    return run


def _screen_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = points(spark, sf_dir).withColumn("s", screen_single("lat", "lon", "height", CAMERA, STEREO, int(WIDTH), int(HEIGHT))).where("s is not null")
    return r.select("id", F.col("s.x").cast("double").alias("x"), F.col("s.y").cast("double").alias("y"))


def _matrices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points of the suppliers under each of the three view matrices, whose entries are float32; lengths are in thousands of kilometres."""
    k = F.col("s_suppkey")
    p = table(spark, sf_dir, "supplier").select(k.alias("id"), *((k * n % 2000 / 1000.0 - 1.0).alias(c) for c, n in (("x", 37), ("y", 91), ("z", 53))))
    of = {"2D": CAMERA.matrix_2d(STEREO), "2.5D": CAMERA.matrix_tilted(STEREO), "3D": CAMERA.matrix_globe()}
    at = F.explode(F.array(*(F.struct(F.lit(mode).alias("mode"), *(transformed(m, F.col("x") * 1e6, F.col("y") * 1e6, F.col("z") * 1e6, r).alias(f"m{r}") for r in range(4))) for mode, m in of.items())))
    return p.select("id", at.alias("at")).select("id", "at.mode", *(rnd(f"at.m{r}", 3).alias(f"m{r}") for r in range(4)))


def camera_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The wheel, pitch and roll of cameras, whose limits are reached."""
    k = F.col("c_custkey") % 161 - 80
    zoom = (F.col("c_custkey") % 9 + 1) / 3.0
    r = table(spark, sf_dir, "customer").select("c_custkey", zoomed(zoom, k).alias("zoom"), pitched(k / 10.0).alias("pitch"), rolled(k / 10.0).alias("roll"))
    return r.select("c_custkey", rnd("zoom", 7).alias("zoom"), rnd("pitch", 8).alias("pitch"), rnd("roll", 8).alias("roll"))


QUERIES = {
    f.__name__: f
    for f in (haversine_inverse, haversine_direct, vincenty_inverse, vincenty_direct, vincenty_inverse_columns, vincenty_direct_columns, lla_ecef, ecef_lla, lla_enu, enu_lla, chord_distance, normalize_angles, validate_coords, camera_controls)
} | {
    "lcc_project": _projected(LCC), "stereo_project": _projected(STEREO), "mercator_project": _projected(WebMercator()), "mercator_unproject": _returned(WebMercator()),
    "lcc_unproject": _returned(LCC), "stereo_unproject": _returned(STEREO), "screen_2d": _screen("2D"), "screen_25d": _screen("2.5D"), "screen_3d_cull": _screen("3D"),
    "view_matrices": _matrices, "screen_single": _screen_single,
}

# -- SQL

_P, _Q = ecef_sql("lat1", "lon1", "height"), ecef_sql("lat2", "lon2", "500e0")
_D = direct_sql("lat1", "lon1", "bearing", "distance")
_E = ecef_sql("lat", "lon", "height")

_SERIES = "u2*(a2-b2)/b2"

def vincenty_inverse_sql(source: str) -> str:
    """CTEs after a table pairs(id, lat1, lon1, lat2, lon2): geo(id, done, d, b1, b2)."""
    return f"""{source},
start AS (SELECT id, lat1, lon1, lat2, lon2, atan((1-{F_})*tan(lat1)) AS u1, atan((1-{F_})*tan(lat2)) AS u2, lon2-lon1 AS l FROM pairs),
step AS (
    SELECT id, u1, u2, l, l AS lam, 0 AS i, false AS done, 0e0 AS ss, 0e0 AS cs, 0e0 AS sg, 0e0 AS q, 0e0 AS cm FROM start
    UNION ALL
    SELECT id, u1, u2, l, l+(1-c)*{F_}*sa*(sg+c*ss*(cm+c*cs*(-1+2*cm*cm))), i+1, abs(l+(1-c)*{F_}*sa*(sg+c*ss*(cm+c*cs*(-1+2*cm*cm)))-lam) < 1e-12, ss, cs, sg, q, cm
    FROM (SELECT *, {F_}/16*q*(4+{F_}*(4-3*q)) AS c, cs - CASE WHEN q = 0 THEN cs ELSE 2*sin(u1)*sin(u2)/q END AS cm
    FROM (SELECT *, cos(u1)*cos(u2)*sin(lam)/ss AS sa, 1-pow(cos(u1)*cos(u2)*sin(lam)/ss,2) AS q, atan2(ss,cs) AS sg
    FROM (SELECT id, u1, u2, l, lam, i, sqrt(pow(cos(u2)*sin(lam),2)+pow(cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(lam),2)) AS ss, sin(u1)*sin(u2)+cos(u1)*cos(u2)*cos(lam) AS cs
          FROM step WHERE NOT done AND i < 200)))
),
last AS (SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1),
coef AS (SELECT *, q*({A}*{A}-{B}*{B})/({B}*{B}) AS us FROM last),
ab AS (SELECT *, 1+us/16384*(4096+us*(-768+us*(320-175*us))) AS ca, us/1024*(256+us*(-128+us*(74-47*us))) AS cb FROM coef),
geo AS (SELECT id, done, {B}*ca*(sg-cb*ss*(cm+cb/4*(cs*(-1+2*cm*cm)-cb/6*cm*(-3+4*ss*ss)*(-3+4*cm*cm)))) AS d,
    atan2(cos(u2)*sin(lam), cos(u1)*sin(u2)-sin(u1)*cos(u2)*cos(lam)) AS b1, atan2(cos(u1)*sin(lam), -sin(u1)*cos(u2)+cos(u1)*sin(u2)*cos(lam)) AS b2 FROM ab)"""


VINCENTY_INVERSE = f"""WITH RECURSIVE {vincenty_inverse_sql(PAIRS)}
SELECT p.id, {rsql(f"CASE WHEN done THEN d ELSE {hav_sql('lat1', 'lon1', 'lat2', 'lon2')} END", 2)} AS distance,
    {rsql(wrap_sql(f"CASE WHEN done THEN b1 ELSE {bearing_sql('lat1', 'lon1', 'lat2', 'lon2')} END"), 7)} AS initial_bearing,
    {rsql(wrap_sql(f"CASE WHEN done THEN b2 ELSE {bearing_sql('lat2', 'lon2', 'lat1', 'lon1')} + pi() END"), 7)} AS final_bearing
FROM pairs p JOIN geo USING (id)"""


def vincenty_direct_sql(source: str) -> str:
    """CTEs after a table d0(id, lat, lon, bearing, distance): moved(id, lat, lon)."""
    return f"""{source},
d1 AS (SELECT *, atan((1-{F_})*tan(lat)) AS u FROM d0),
d2 AS (SELECT *, atan2(sin(u), cos(u)*cos(bearing)) AS s1, cos(u)*sin(bearing) AS sa, 1-pow(cos(u)*sin(bearing),2) AS q FROM d1),
d3 AS (SELECT *, q*({A}*{A}-{B}*{B})/({B}*{B}) AS us FROM d2),
d4 AS (SELECT *, distance/({B}*(1+us/16384*(4096+us*(-768+us*(320-175*us))))) AS straight, us/1024*(256+us*(-128+us*(74-47*us))) AS cb FROM d3),
dstep AS (
    SELECT id, s1, straight, cb, straight AS sg, 0e0 AS cm, 0 AS i, false AS done FROM d4
    UNION ALL
    SELECT id, s1, straight, cb, new, cm, i+1, abs(new-sg) < 1e-12 FROM (
        SELECT id, s1, straight, cb, sg, cm, i, straight+cb*sin(sg)*(cm+cb/4*(cos(sg)*(-1+2*cm*cm)-cb/6*cm*(-3+4*pow(sin(sg),2))*(-3+4*cm*cm))) AS new
        FROM (SELECT id, s1, straight, cb, sg, i, cos(2*s1+sg) AS cm FROM dstep WHERE NOT done AND i < 200))
),
dlast AS (SELECT id, sg, cm FROM dstep QUALIFY row_number() OVER (PARTITION BY id ORDER BY i DESC) = 1),
d5 AS (SELECT *, {F_}/16*q*(4+{F_}*(4-3*q)) AS c, cos(sg) AS co, sin(sg) AS si FROM d4 JOIN dlast USING (id)),
d6 AS (SELECT id, atan2(sin(u)*co+cos(u)*si*cos(bearing), (1-{F_})*sqrt(sa*sa+pow(sin(u)*si-cos(u)*co*cos(bearing),2))) AS lat2,
    lon + atan2(si*sin(bearing), cos(u)*co-sin(u)*si*cos(bearing)) - (1-c)*{F_}*sa*(sg+c*si*(cm+c*co*(-1+2*cm*cm))) AS lon2, lat, lon, distance FROM d5),
moved AS (SELECT id, CASE WHEN abs(distance) < 1e-12 THEN lat ELSE lat2 END AS lat, CASE WHEN abs(distance) < 1e-12 THEN lon ELSE {wrap_sql("lon2", "(-pi())")} END AS lon FROM d6)"""


def _projected_sql(x: str, y: str) -> str:
    return f"WITH {POINTS} SELECT id, {rsql(x, 1)} AS x, {rsql(y, 1)} AS y FROM points"


_E1 = repr(E2 and float(E2[:-2]) ** 0.5)
_LCC_T = f"(tan(pi()/4-lat/2)*pow((1+{_E1}*sin(lat))/(1-{_E1}*sin(lat)), {_E1}/2))"
_lcc_m = lambda p: f"(cos({p})/sqrt(1-{E2}*pow(sin({p}),2)))"
_lcc_t = lambda p: _LCC_T.replace("lat", p)
_P1, _P2 = "radians(33e0)", "radians(45e0)"
_LCC_N = f"((ln({_lcc_m(_P1)})-ln({_lcc_m(_P2)}))/(ln({_lcc_t(_P1)})-ln({_lcc_t(_P2)})))"
_lcc_rho = lambda t: f"({A}*{_lcc_m(_P1)}/({_LCC_N}*pow({_lcc_t(_P1)}, {_LCC_N}))*pow({t}, {_LCC_N}))"
_LCC_RHO, _LCC_RHO_0 = _lcc_rho(_LCC_T), _lcc_rho(_lcc_t("0e0"))
_LCC_THETA = f"({_LCC_N}*(lon-radians(-96e0)))"
CHI = f"(2*atan(tan(pi()/4+lat/2)*pow((1-{_E1}*sin(lat))/(1+{_E1}*sin(lat)), {_E1}/2))-pi()/2)"
_LAT_C = "radians(-23.5505e0)"
_CC, _DL = CHI.replace("lat", _LAT_C), "(lon-radians(-46.6333e0))"
_K = f"(2*{A}*sqrt(1-{E2})/(1-{E2}*pow(sin({_LAT_C}),2))/(1+sin({_CC})*sin({CHI})+cos({_CC})*cos({CHI})*cos({_DL})))"
STEREO_X = f"({_K}*cos({CHI})*sin({_DL}))"
STEREO_Y = f"({_K}*(cos({_CC})*sin({CHI})-sin({_CC})*cos({CHI})*cos({_DL})))"
_BACK = f"WITH {POINTS} SELECT id, {rsql('lat', 6)} AS lat, {rsql(wrap_sql('lon', '(-pi())'), 6)} AS lon FROM points"


def _pixels_sql(matrix: list[str], x: str, y: str, z: str, more: str = "true") -> str:
    row = lambda k: f"({matrix[k]}*px+{matrix[4 + k]}*py+{matrix[8 + k]}*pz+{matrix[12 + k]})"
    return f"""WITH {POINTS}, img AS (SELECT id, {x} AS px, {y} AS py, {z} AS pz FROM points)
SELECT id, {rsql(f"({row(0)}/{row(3)}+1)*0.5*{WIDTH!r}", 3)} AS x, {rsql(f"(1-{row(1)}/{row(3)})*0.5*{HEIGHT!r}", 3)} AS y FROM img WHERE {row(3)} > 0 AND {more}"""


#: The three matrices of CAMERA, worked out apart from this package with loops over float32 numbers; column after column.
_MATRIX_2D = (3.821346e-07, -1.5761078e-07, 0.0, 0.0, 1.18208085e-07, 5.095128e-07, 0.0, 0.0, 0.0, 0.0, -0.001, 0.0, 0.0, 0.0, 0.0, 1.0)
_MATRIX_TILTED = (
    1.7003454, -0.65712994, 0.21030076, 0.20988058, 0.59966236, 2.1243224, -0.3413462, -0.3406642, 0.16649501, -0.940139, -0.91829425, -0.9164595, 0.0, 0.0, 3927928.0, 4000000.0,
)
_MATRIX_GLOBE = (
    1.5054351, -0.48667365, -0.51906884, -0.5177728, 0.88242936, -0.44174492, 0.85595644, 0.8538192, 0.48319113, 2.323023, 0.054023214, 0.05388832, 0.0, 0.0, 758171300.0, 756378100.0,
)


def _single(matrix: tuple[float, ...]) -> list[str]:
    return [f"({v!r}::FLOAT)::DOUBLE" for v in matrix]


#: The camera has the projection's centre, whose image is 0, 0.
_ROT = "px*cos(-0.3e0)-py*sin(-0.3e0)", "px*sin(-0.3e0)+py*cos(-0.3e0)"
_W = "(100000e0/0.02e0)"


def _globe_sql() -> str:
    c = ecef_sql(_LAT_C, "radians(-46.6333e0)", "15e6/0.02e0")
    return _pixels_sql(_single(_MATRIX_GLOBE), *_E, f"{c[0]}*px+{c[1]}*py+{c[2]}*pz >= {A}*{A}")


def _native_sql() -> str:
    """2D in float32 with the camera's aspect."""
    one = lambda x: f"({x})::FLOAT"
    w = one(_W)
    half_w, half_h = f"({w}/2::FLOAT)", f"({w}/{one('4e0/3')}/2::FLOAT)"
    return f"""WITH {POINTS}, img AS (SELECT id, {STEREO_X} AS px, {STEREO_Y} AS py FROM points)
        SELECT id, (({one(_ROT[0])}/{half_w}+1::FLOAT)*0.5::FLOAT*800::FLOAT)::DOUBLE AS x, ((1::FLOAT-{one(_ROT[1])}/{half_h})*0.5::FLOAT*600::FLOAT)::DOUBLE AS y FROM img"""


ORACLE_SQL = {
    "haversine_inverse": f"""WITH {PAIRS} SELECT id, {rsql(hav_sql('lat1', 'lon1', 'lat2', 'lon2'), 2)} AS distance,
        {rsql(wrap_sql(bearing_sql('lat1', 'lon1', 'lat2', 'lon2')), 8)} AS initial_bearing,
        {rsql(wrap_sql(bearing_sql('lat2', 'lon2', 'lat1', 'lon1') + '+pi()'), 8)} AS final_bearing FROM pairs""",
    "haversine_direct": f"WITH {PAIRS} SELECT id, {rsql(_D[0], 8)} AS lat, {rsql(_D[1], 8)} AS lon, {rsql('height', 2)} AS height FROM pairs",
    "vincenty_inverse": VINCENTY_INVERSE,
    "vincenty_direct": f"""WITH RECURSIVE {vincenty_direct_sql(PAIRS + ', d0 AS (SELECT id, lat1 AS lat, lon1 AS lon, bearing, distance FROM pairs)')}
        SELECT m.id, {rsql('m.lat', 8)} AS lat, {rsql('m.lon', 8)} AS lon, {rsql('p.height', 2)} AS height FROM moved m JOIN pairs p USING (id)""",
    "lla_ecef": f"WITH {POINTS} SELECT id, {rsql(_E[0], 2)} AS x, {rsql(_E[1], 2)} AS y, {rsql(_E[2], 2)} AS z FROM points",
    "ecef_lla": f"WITH {POINTS} SELECT id, {rsql('lat', 8)} AS lat, {rsql('lon', 8)} AS lon, {rsql('height', 2)} AS height FROM points",
    "lla_enu": f"""WITH {PAIRS}, d AS (SELECT id, lat1 AS a, lon1 AS o, {_Q[0]}-({_P[0]}) AS dx, {_Q[1]}-({_P[1]}) AS dy, {_Q[2]}-({_P[2]}) AS dz FROM pairs),
        e AS (SELECT id, -sin(o)*dx+cos(o)*dy AS east, -sin(a)*cos(o)*dx-sin(a)*sin(o)*dy+cos(a)*dz AS north, cos(a)*cos(o)*dx+cos(a)*sin(o)*dy+sin(a)*dz AS up FROM d)
        SELECT id, {rsql('east', 2)} AS east, {rsql('north', 2)} AS north, {rsql('up', 2)} AS up, {rsql('sqrt(east*east+north*north)', 2)} AS flat,
        {rsql('sqrt(east*east+north*north+up*up)', 2)} AS slant FROM e""",
    "enu_lla": f"WITH {PAIRS} SELECT id, {rsql('lat2', 7)} AS lat, {rsql('lon2', 7)} AS lon, 500e0 AS height FROM pairs",
    "chord_distance": f"""WITH {PAIRS} SELECT id, {rsql('sqrt(' + '+'.join(f"pow(({p})-({q}),2)" for p, q in zip(_P, ecef_sql('lat2', 'lon2', '0e0'), strict=True)) + ')', 2)} AS chord FROM pairs""",
    "normalize_angles": f"""WITH x AS (SELECT l_orderkey, l_linenumber, l_partkey, ((l_partkey*17+l_orderkey*3) % 4001 - 2000)/100e0 AS x FROM lineitem)
        SELECT l_orderkey, l_linenumber, l_partkey, {rsql(wrap_sql('x'), 8)} AS bearing, {rsql(wrap_sql('x', '(-pi())'), 8)} AS longitude FROM x""",
    "validate_coords": """SELECT c_custkey, CASE WHEN c_custkey*7 % 200 - 100 NOT BETWEEN -90 AND 90 THEN 'LatitudeOutOfRange'
        WHEN c_custkey*11 % 400 - 200 NOT BETWEEN -180 AND 180 THEN 'LongitudeOutOfRange' ELSE 'ok' END AS status FROM customer""",
    "lcc_project": _projected_sql(f"{_LCC_RHO}*sin({_LCC_THETA})", f"{_LCC_RHO_0}-{_LCC_RHO}*cos({_LCC_THETA})"),
    "stereo_project": _projected_sql(STEREO_X, STEREO_Y),
    "mercator_project": _projected_sql(f"{A}*lon", f"{A}*ln(tan(pi()/4+lat/2))"),
    "mercator_unproject": _BACK, "lcc_unproject": _BACK, "stereo_unproject": _BACK,
    "camera_controls": f"""WITH c AS (SELECT c_custkey, c_custkey % 161 - 80 AS k, (c_custkey % 9 + 1)/3e0 AS zoom FROM customer)
        SELECT c_custkey, {rsql('greatest(0.02e0, least(1000e0, zoom*pow(CASE WHEN k > 0 THEN 1.1e0 ELSE 0.9e0 END, abs(k))))', 7)} AS zoom,
        {rsql('greatest(-pi(), least(pi(), k/10e0))', 8)} AS pitch, {rsql(wrap_sql('k/10e0', '(-pi())'), 8)} AS roll FROM c""",
    "screen_2d": f"""WITH {POINTS}, img AS (SELECT id, {STEREO_X} AS px, {STEREO_Y} AS py FROM points)
        SELECT id, {rsql(f"(({_ROT[0]})/({_W}/2)+1)*0.5*{WIDTH!r}", 3)} AS x,
        {rsql(f"(1-({_ROT[1]})/({_W}/(800e0/600e0)/2))*0.5*{HEIGHT!r}", 3)} AS y FROM img""",
    "screen_25d": _pixels_sql(_single(_MATRIX_TILTED), STEREO_X, STEREO_Y, "height"),
    "screen_3d_cull": _globe_sql(), "screen_single": _native_sql(),
    "view_matrices": "WITH p AS (SELECT s_suppkey AS id, (s_suppkey*37 % 2000/1e3 - 1)*1e6 AS x, (s_suppkey*91 % 2000/1e3 - 1)*1e6 AS y, (s_suppkey*53 % 2000/1e3 - 1)*1e6 AS z FROM supplier) " + " UNION ALL ".join(
        f"SELECT id, '{mode}' AS mode, " + ", ".join(f"{rsql(f'{m[r]}*x + {m[4 + r]}*y + {m[8 + r]}*z + {m[12 + r]}', 3)} AS m{r}" for r in range(4)) + " FROM p"
        for mode, m in (("2D", _single(_MATRIX_2D)), ("2.5D", _single(_MATRIX_TILTED)), ("3D", _single(_MATRIX_GLOBE)))
    ),
}

ORACLE_SQL |= {f"{name}_columns": ORACLE_SQL[name] for name in ("vincenty_inverse", "vincenty_direct")}

__all__ = ["ORACLE_SQL", "QUERIES", "R1", "EP2"]
