"""SQL text for the geometry the oracles share."""

from __future__ import annotations

# Expected values, written out so that the SQL does not use what it checks.
COMPASS_16 = "N NNE NE ENE E ESE SE SSE S SSW SW WSW W WNW NW NNW".split()
# Gaussian weights by sigma, from the middle outwards to 4 sigma.
GAUSS = {
    1.0: (0.39894346935609776, 0.24197144565660073, 0.05399112742070441, 0.0044318616200312655, 0.00013383062461474175),
    1.2: (0.33245273318208446, 0.23492715137221082, 0.08289782333300186, 0.014606953670741623, 0.0012852357166313988, 5.646931637206618e-05),
    2.6: (0.15344676716153935, 0.1425067284950445, 0.11414798549891995, 0.07885992991890269, 0.04698938666078063, 0.02414895932672452, 0.010704153242424267, 0.004092243522270417, 0.001349353923205992, 0.0003837474798722142, 9.41283510851545e-05),
    3.2: (0.12467230175220938, 0.11873101826467888, 0.10255263807396316, 0.08033742554712815, 0.05707913903101913, 0.036781153614318454, 0.021496200722687906, 0.011394269846016722, 0.005477718646764244, 0.002388368707997491, 0.000944477144308181, 0.0003387427138145149, 0.00011018866003474737, 3.250815116375384e-05),
}


def gauss_weights(sigma: float) -> list[float]:
    """The weights of a Gaussian from end to end."""
    return [*GAUSS[sigma][:0:-1], *GAUSS[sigma]]


def hav(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    a = (
        f"(pow(sin(radians({lat2}-({lat1}))/2),2)+cos(radians({lat1}))*cos(radians({lat2}))"
        f"*pow(sin(radians({lon2}-({lon1}))/2),2))"
    )
    return f"(12742e0*atan2(sqrt({a}),sqrt(1-{a})))"


def bearing(lat1: str, lon1: str, lat2: str, lon2: str) -> str:
    turn = f"radians({lon2}-({lon1}))"
    east = f"sin({turn})*cos(radians({lat2}))"
    north = (
        f"cos(radians({lat1}))*sin(radians({lat2}))"
        f"-sin(radians({lat1}))*cos(radians({lat2}))*cos({turn})"
    )
    return mod360(f"degrees(atan2({east},{north}))+360")


def mod360(x: str) -> str:
    return f"((({x})%360+360)%360)"


def compass(course: str) -> str:
    names = ", ".join(f"'{n}'" for n in COMPASS_16)
    return f"([{names}])[CAST(floor(({course}+11.25e0)/22.5e0) AS BIGINT)%16+1]"


def dest_lat(lat: str, course: str, km: str) -> str:
    arc = f"({km}/6371e0)"
    sine = (
        f"sin(radians({lat}))*cos({arc})+cos(radians({lat}))*sin({arc})*cos(radians({course}))"
    )
    return f"degrees(asin(greatest(-1e0, least(1e0, {sine}))))"


def dest_lon(lat: str, lon: str, course: str, km: str) -> str:
    arc = f"({km}/6371e0)"
    end = f"radians({dest_lat(lat, course, km)})"
    east = f"sin(radians({course}))*sin({arc})*cos(radians({lat}))"
    north = f"cos({arc})-sin(radians({lat}))*sin({end})"
    turned = f"degrees(radians({lon})+atan2({east},{north}))+540"
    return f"({mod360(turned)}-180)"


def icon(wind: str, kind: str) -> str:
    return (
        f"CASE WHEN {wind} IS NULL THEN 'LOW.png' ELSE concat(CASE WHEN {wind}<34 THEN 'TD' "
        f"WHEN {wind}<64 THEN 'TS' ELSE 'TY' END, CASE WHEN {kind}='past' THEN 'gray' ELSE '' END, '.png') END"
    )


def cone(lead: str) -> str:
    knots = [(12, 45), (24, 80), (48, 150), (72, 225), (96, 325), (120, 450)]
    arms = " ".join(
        f"WHEN {lead}<={h1} THEN round_even({k0}e0+({lead}-{h0}e0)/{h1 - h0}e0*{k1 - k0}e0,1)"
        for (h0, k0), (h1, k1) in zip(knots, knots[1:])
    )
    return f"CASE WHEN {lead} IS NULL OR {lead}<=12 THEN 45e0 WHEN {lead}>=120 THEN 450e0 {arms} END"


def hours(a: str, b: str) -> str:
    return f"((epoch_us({b})-epoch_us({a}))/3.6e9)"


def reflect(x: str, n: int) -> str:
    m = f"((({x})%{2 * n}+{2 * n})%{2 * n})"
    return f"(CASE WHEN {m}<{n} THEN {m} ELSE {2 * n - 1}-{m} END)"


def gauss(source: str, out: str, weights: list[float], shape: tuple[int, int], keys: str) -> str:
    """CTEs for Gaussian smoothing in gather form: each cell looks its neighbours up."""
    radius = len(weights) // 2
    rows = ", ".join(f"({k - radius}, {w!r}::DOUBLE)" for k, w in enumerate(weights))
    same = " AND ".join(f"s.{k}=c.{k}" for k in keys.split(",") if k)
    same = f"{same} AND " if same else ""
    names = ", ".join(f"c.{k}" for k in keys.split(",") if k)
    names = f"{names}, " if names else ""
    by = "GROUP BY ALL"
    return (
        f"{out}_k(d, w) AS (VALUES {rows}), "
        f"{out}_r AS (SELECT {names}c.lat_idx, c.lon_idx, sum(k.w*coalesce(s.value,0e0)) AS value FROM {source} c, {out}_k k, "
        f"{source} s WHERE {same}s.lon_idx=c.lon_idx AND s.lat_idx={reflect('c.lat_idx+k.d', shape[0])} {by}), "
        f"{out} AS (SELECT {names}c.lat_idx, c.lon_idx, sum(k.w*s.value) AS value FROM {out}_r c, {out}_k k, "
        f"{out}_r s WHERE {same}s.lat_idx=c.lat_idx AND s.lon_idx={reflect('c.lon_idx+k.d', shape[1])} {by})"
    )


def cloud_norm(v: str, lo: str, hi: str) -> str:
    c = f"coalesce({v},0e0)"
    clip = lambda x: f"greatest(0e0,least(1e0,{x}))"
    return (
        f"(CASE WHEN {hi}<=1.05e0 THEN {clip(c)} WHEN {hi}<=100.5e0 THEN {clip(c + '/100')} "
        f"WHEN {hi}-{lo}<1e-9 THEN 0e0 ELSE {clip(f'({c}-{lo})/({hi}-{lo})')} END)"
    )


def cubic(d: str) -> str:
    a = f"abs({d})"
    return (
        f"(CASE WHEN {a}<1 THEN ({a}*1.5e0-2.5e0)*{a}*{a}+1e0 "
        f"WHEN {a}<2 THEN (({a}*-0.5e0+2.5e0)*{a}-4e0)*{a}+2e0 ELSE 0e0 END)"
    )
