"""The registered queries as DuckDB SQL, written from the rules rather than from the Spark code.

Derived tables are common table expressions over the given tables; `sql` puts together the ones
a query needs. Garments are enumerated naively here: no folding, no splitting.
"""

from __future__ import annotations

import re

from perchero import lookups as L
from perchero.functions import text
from perchero.sources import testdata as fixture

ROLES = L.ROLES


# --- SQL helpers ------------------------------------------------------------------------------

def q(value) -> str:
    """A literal; numbers become doubles unless they are integers."""
    if value is None:
        return "null"
    if isinstance(value, bool):
        return str(value).lower()
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        return f"cast({value!r} as double)"
    return "'" + value.replace("'", "''") + "'"


def items(values) -> str:
    return "[" + ", ".join(q(v) for v in values) + "]"


def among(expr: str, values) -> str:
    return f"coalesce({expr} in ({', '.join(q(v) for v in values)}), false)"


def h(key: str, salt: str) -> str:
    return f"cast('0x' || substr(md5(concat_ws(':', {key}, {q(salt)})), 1, 8) as bigint)"


def pick(values, key: str, salt: str) -> str:
    return f"list_extract({items(values)}, {h(key, salt)} % {len(values)} + 1)"


def pick_from(column: str, key: str, salt: str) -> str:
    return f"list_extract({column}, {h(key, salt)} % len({column}) + 1)"


def case(pairs, default: str = "null") -> str:
    pairs = list(pairs)
    if not pairs:
        return default
    whens = " ".join(f"when {c} then {v}" for c, v in pairs)
    return f"(case {whens} else {default} end)"


def on(condition: str, points: float) -> str:
    return f"(case when {condition} then {q(float(points))} else {q(0.0)} end)"


def has(column: str, keywords) -> str:
    tests = " or ".join(f"contains({column}, {q(k)})" for k in keywords)
    return f"coalesce({tests}, false)" if keywords else "false"


def total(terms) -> str:
    return "(" + " + ".join(terms) + ")"


def r6(expr: str, alias: str) -> str:
    return f"round({expr}, 6) as {alias}"


def one_of(mapping, key: str, default: str = "null") -> str:
    return case(((f"{key} = {q(k)}", q(v)) for k, v in mapping.items()), default)


def list_of(mapping, key: str) -> str:
    return case(((f"{key} = {q(k)}", items(v)) for k, v in mapping.items()))


# --- derived tables -----------------------------------------------------------------------------

CTES: dict[str, str] = {}


def user_columns(key: str) -> str:
    return ", ".join([
        f"cast(18 + {h(key, 'age')} % 48 as int) as age",
        f"{pick(L.BODY_SHAPES, key, 'body_shape')} as body_shape",
        f"{pick(L.STYLES, key, 'style_preference')} as style_preference",
        f"{pick(L.SKIN_TONES, key, 'skin_tone')} as skin_tone",
        f"{pick(L.GENDERS, key, 'gender')} as gender",
    ])


CTES["users"] = (
    f"select c_custkey as user_id, c_name as username, {user_columns('c_custkey')} from customer"
)
CTES["made_users"] = (
    "select c_custkey as user_id, 'user_' || c_custkey as username, "
    f"{user_columns('c_custkey')} from customer"
)
CTES["meta"] = "select * from (values " + ", ".join(
    f"({q(t)}, {level}, {q(role)})" for t, (level, role) in L.GARMENT_META.items()
) + ") as m(meta_type, base_formality, role)"
CTES["palettes"] = "select * from (values " + ", ".join(
    f"({q(s)}, {q(g)}, {items(t)}, {items(c)}, {items(p)}, "
    f"{items([x for x in L.COLORS if x not in c])})"
    for (s, g), (t, c, p) in L.PALETTES.items()
) + ") as p(style, palette_gender, types, colors, patterns, off_colors)"


def with_palette(users: str) -> str:
    return f"""select u.*, p.palette_gender, p.types, p.colors, p.patterns, p.off_colors
    from {users} u join palettes p on p.style = u.style_preference and p.palette_gender =
      case when exists (select 1 from palettes x where x.style = u.style_preference
                        and x.palette_gender = u.gender) then u.gender
           else {q(L.FALLBACK_GENDER)} end"""


CTES["user_palettes"] = with_palette("users")
CTES["made_user_palettes"] = with_palette("made_users")


def group_of(type_: str) -> str:
    return case(
        [(has(f"lower({type_})", L.SHOES_KEYWORDS), "'shoes'"),
         (has(f"lower({type_})", L.BOTTOM_KEYWORDS), "'bottom'")], "'top'"
    )


def fill(template: str) -> str:
    parts = re.split(r"\{(\w+)\}", template)
    names = {"type": "type", "material": "material", "color": "primary_color",
             "pattern": "pattern", "adjective": "adjective"}
    return " || ".join(q(p) if i % 2 == 0 else names[p] for i, p in enumerate(parts))


def garment_tables(prefix: str, keys: str) -> None:
    """CTEs from (garment_id, user_id, palette) rows to full garments."""
    k = "garment_id"
    CTES[f"{prefix}drawn"] = f"""select garment_id, user_id,
      {pick_from('types', k, 'type')} as type,
      case when {h(k, 'off')} % 100 < {L.OFF_PALETTE_PERCENT}
        then {pick_from('off_colors', k, 'primary_color')}
        else {pick_from('colors', k, 'primary_color')} end as primary_color,
      {pick_from('patterns', k, 'pattern')} as pattern,
      {pick(L.MATERIALS, k, 'material')} as material
    from ({keys}) as keys"""
    templates = case(
        (f"{h(k, 'description')} % 3 = {i}", fill(t))
        for i, t in enumerate(L.DESCRIPTION_TEMPLATES)
    )
    CTES[f"{prefix}garments"] = f"""select garment_id, user_id,
      type || ' de ' || material || ' ' || primary_color as name,
      type, primary_color, pattern, material,
      cast(greatest(1, least(5, coalesce(base_formality, 1 + {h(k, 'base')} % 5)
        + {pick(L.FORMALITY_SHIFTS, k, 'formality_level')})) as int) as formality_level,
      {templates} || {fill(L.FABRIC_SENTENCE)}
        || case when pattern <> 'liso' then {fill(L.PATTERN_SENTENCE)} else '' end
        as description,
      {group_of('type')} as type_group, '' as image_url
    from (select *, list_extract({list_of(L.MATERIAL_ADJECTIVES, 'material')},
                                 {h(k, 'adjective')} % 2 + 1) as adjective
          from {prefix}drawn) d left join meta on meta_type = type"""


garment_tables("", f"""select o.user_id * {fixture.GARMENT_FACTOR} + o.l_partkey as garment_id, u.*
  from (select distinct o_custkey as user_id, l_partkey from orders
        join lineitem on l_orderkey = o_orderkey) o
  join user_palettes u on u.user_id = o.user_id""")
garment_tables("made_", f"""select user_id * 100 + nth as garment_id, *
  from (select *, unnest(range(1, {L.WARDROBE_SIZE[0]} + 1
          + {h('user_id', 'wardrobe')} % 11)) as nth from made_user_palettes)""")


def season_of(date: str) -> str:
    month = f"month({date})"
    return case([
        (f"{month} between 3 and 5", "'primavera'"), (f"{month} between 6 and 8", "'verano'"),
        (f"{month} between 9 and 11", "'otonio'"),
    ], "'invierno'")


def context_tables(name: str, rows: str) -> None:
    k = "context_id"
    low = one_of({s: lo for s, (lo, _) in L.SEASON_TEMPERATURE.items()}, "season")
    high = one_of({s: hi for s, (_, hi) in L.SEASON_TEMPERATURE.items()}, "season")
    flow = case(((among("activity", a), str(lo)) for a, (lo, _) in L.ACTIVITY_FORMALITY), "1")
    fhigh = case(((among("activity", a), str(hi)) for a, (_, hi) in L.ACTIVITY_FORMALITY), "5")
    CTES[name] = f"""select * exclude (season, activity), season,
      {pick_from(list_of(L.SEASON_WEATHER, 'season'), k, 'weather_condition')}
        as weather_condition,
      cast(10 * {low} + {h(k, 'temp')} % (10 * ({high} - {low}) + 1) as double)
        / cast(10 as double) as temperature,
      activity, {pick(L.MOODS, k, 'mood')} as mood,
      cast({flow} + {h(k, 'cf')} % ({fhigh} - {flow} + 1) as int) as formality_level
    from (select *, {pick(L.ACTIVITIES, k, 'activity')} as activity from ({rows}))"""


context_tables("contexts", f"""select o_orderkey as context_id, o_custkey as user_id,
  {season_of('o_orderdate')} as season from orders""")
context_tables("made_contexts", f"""select o_orderkey as context_id,
  {pick(L.SEASONS, 'o_orderkey', 'season')} as season from orders""")
CTES["requests"] = f"""select * exclude (context_id), context_id as request_id,
  case {h('context_id', 'avoid')} % 4
    when 1 then [{pick(fixture.AVOID_TERMS, 'context_id', 'avoid1')}]
    when 2 then [{pick(fixture.AVOID_TERMS, 'context_id', 'avoid1')},
                 {pick(fixture.AVOID_TERMS, 'context_id', 'avoid2')}]
    else cast([] as varchar[]) end as avoid_items
from contexts"""

CTES["counts"] = """select user_id, count(*) filter (type_group = 'top') as n_top,
  count(*) filter (type_group = 'bottom') as n_bottom,
  count(*) filter (type_group = 'shoes') as n_shoes from garments group by user_id"""
CTES["placed"] = """select user_id, type_group, garment_id, row_number() over (
  partition by user_id, type_group order by garment_id) - 1 as position from garments"""


def draws(attempts: str) -> str:
    places = ", ".join(f"{h('a.rating_id', r)} % c.n_{r} as place_{r}" for r in ROLES)
    joins = " ".join(
        f"join placed {r} on {r}.user_id = d.user_id and {r}.position = d.place_{r} "
        f"and {r}.type_group = '{r}'" for r in ROLES
    )
    chosen = ", ".join(f"{r}.garment_id as {r}_garment_id" for r in ROLES)
    return f"""select d.rating_id, d.user_id, d.context_id, {chosen}
      from (select a.*, {places} from ({attempts}) a join counts c on c.user_id = a.user_id
            where n_top > 0 and n_bottom > 0 and n_shoes > 0) d {joins}"""


CTES["outfits"] = draws("select context_id as rating_id, user_id, context_id from contexts")
CTES["attempts"] = draws(
    "select context_id * 10 + unnest([0, 1, 2]) as rating_id, user_id, context_id from contexts"
)


def prefixed_garments() -> str:
    names = ["user_id", "name", "type", "primary_color", "pattern", "material",
             "formality_level", "description", "type_group"]
    return ", ".join(f"{r}.{n} as {r}_{n}" for r in ROLES for n in names)


def flat(source: str, extra: str = "") -> str:
    joins = " ".join(
        f"left join garments {r} on {r}.garment_id = o.{r}_garment_id "
        f"left join meta {r}m on {r}m.meta_type = {r}.type" for r in ROLES
    )
    roles = ", ".join(f"coalesce({r}m.role, '') as {r}_role" for r in ROLES)
    return f"""select o.*, u.username, u.age, u.body_shape, u.style_preference, u.skin_tone,
      u.gender, c.season, c.weather_condition, c.temperature, c.activity, c.mood,
      c.formality_level as context_formality, {prefixed_garments()}, {roles}{extra}
    from {source} o left join users u on u.user_id = o.user_id
    left join contexts c on c.context_id = o.context_id {joins}"""


# --- expert rating --------------------------------------------------------------------------------

def expert_terms() -> dict[str, list[str]]:
    tf, bf, sf = (f"coalesce({r}_formality_level, 3)" for r in ROLES)
    tr, br, sr = (f"{r}_role" for r in ROLES)
    smart = "('formal', 'smart')"
    sporty = "('sport', 'sport_casual')"
    a = "activity"
    cf = "context_formality"
    sport = f"{a} in ('deporte', 'gimnasio', 'senderismo')"
    activity = [
        on(f"{a} = 'trabajo_oficina' and {tf} >= 3 and {bf} >= 3", 1.0),
        on(f"{a} = 'trabajo_oficina' and {tr} in {smart} and {br} in {smart}", 0.7),
        on(f"{a} = 'trabajo_oficina' and {sr} = 'sport' and {cf} >= 3", -1.0),
        on(f"{a} = 'trabajo_oficina' and top_type in ('camiseta', 'croptop', 'hoodie') "
           f"and {tf} < 3", -1.2),
        on(f"{a} = 'evento_formal' and {tf} >= 4 and {bf} >= 4 and {sf} >= 4", 1.5),
        on(f"{a} = 'evento_formal' and {tr} = 'formal' and {br} = 'formal' and {sr} in {smart}",
           1.0),
        on(f"{a} = 'evento_formal' and {sr} = 'sport'", -2.0),
        on(f"{sport} and {tr} in {sporty}", 1.0), on(f"{sport} and {tr} not in {sporty}", -0.8),
        on(f"{sport} and {br} in {sporty}", 1.0), on(f"{sport} and {br} not in {sporty}", -0.8),
        on(f"{sport} and {sr} = 'sport'", 1.5), on(f"{sport} and {sr} in {smart}", -2.0),
        on(f"{sport} and {tf} >= 4", -1.0), on(f"{sport} and {bf} >= 4", -1.0),
        on(f"{sport} and {sf} >= 4", -1.0),
        on(f"{a} = 'relax_en_casa' and {tf} <= 2 and {bf} <= 2", 0.8),
        on(f"{a} = 'relax_en_casa' and ({tf} >= 4 or {bf} >= 4 or {sf} >= 4)", -1.2),
        on(f"{a} = 'casual_paseo' and {tf} between 1 and 3 and {bf} between 1 and 3", 0.7),
        on(f"{a} = 'casual_paseo' and {tr} = 'formal' and {br} = 'formal' and {cf} <= 2", -0.8),
        on(f"{a} = 'fiesta_nocturna' and {tf} between 2 and 4 and {bf} between 2 and 4", 0.5),
        on(f"{a} = 'fiesta_nocturna' and {sr} = 'sport' and {cf} >= 3", -0.5),
        on(f"{a} = 'cita_romantica' and {tf} between 3 and 5 and {bf} between 3 and 5", 0.8),
        on(f"{a} = 'cita_romantica' and {sr} in {smart}", 0.8),
        on(f"{a} = 'cita_romantica' and {sr} = 'sport'", -1.5),
    ]
    rain = among("weather_condition", L.RAIN_WEATHER)
    climate = [
        on("season = 'invierno' and top_material in ('lana', 'tweed')", 1.0),
        on("season = 'invierno' and top_material in ('lino', 'seda')", -2.0),
        on("season = 'verano' and top_material in ('lino', 'algodon')", 1.0),
        on("season = 'verano' and top_material in ('lana', 'tweed')", -2.0),
        on(f"{rain} and contains(shoes_type, 'bota')", 0.5),
        on(f"{rain} and contains(shoes_type, 'sneaker') "
           "and shoes_material not in ('cuero', 'sintetico')", -0.5),
    ]
    busy = {r: f"{one_of(L.PATTERN_COMPLEXITY, f'{r}_pattern', '0')} > 1" for r in ROLES}
    body = [
        total([q(0.0), *(
            on(f"body_shape = {q(s)} and {has(f'{r}_type', kw[i])}", points)
            for s, kw in L.BODY_SHAPE_KEYWORDS.items() if kw[i]
        )])
        for i, r, points in ((0, "top", 0.4), (1, "bottom", 0.4), (2, "top", -0.5))
    ]

    def tone(index: int) -> str:
        return " or ".join(
            f"(skin_tone = {q(t)} and ({among('top_primary_color', c[index])} "
            f"or {among('bottom_primary_color', c[index])}))"
            for t, c in L.COLORIMETRY.items() if c[index]
        )

    gender = [
        on(f"gender = 'mujer' and top_type = 'vestido' and {cf} > 2", 0.7),
        on("gender = 'mujer' and (contains(bottom_type, 'falda') "
           "or contains(bottom_name, 'falda'))", 0.2),
        on("gender = 'hombre' and top_type = 'camisa' and bottom_type = 'pantalones_sastre'",
           0.8),
        on("gender = 'hombre' and top_type = 'blazer' and bottom_type = 'jeans'", 0.4),
        on(f"gender = 'no_binario' and {tf} > 3 and {bf} < 3", 0.3),
        on("gender = 'no_binario' and (contains(top_name, 'estructurado') "
           "or contains(top_name, 'asimetrico'))", 0.5),
    ]
    return {
        "activity": activity,
        "climate": climate,
        "patterns": [
            on(f"{busy['top']} and {busy['bottom']}", -1.2),
            on("top_pattern in ('floral', 'animal_print') and bottom_pattern <> 'liso'", -1.2),
        ],
        "color": [on("top_primary_color = bottom_primary_color and top_pattern <> 'liso'", -1.0)],
        "body": body,
        "colorimetry": [on(tone(1), -0.5), on(tone(0), 0.3)],
        "gender": gender,
    }


def expert_score() -> str:
    return total([q(L.BASE_RATING), *(t for block in expert_terms().values() for t in block)])


def bounded(expr: str) -> str:
    return f"greatest({q(1.0)}, least({q(5.0)}, {expr}))"


NOISE = (
    f"(cast({h('rating_id', 'noise')} % 8001 as double) / {q(10000.0)} - {q(0.4)})"
)
CTES["rated"] = f"select *, {expert_score()} as score, {NOISE} as noise from ({flat('outfits')})"
CTES["ratings"] = f"""select rating_id, user_id, context_id, top_garment_id, bottom_garment_id,
  shoes_garment_id, {bounded('round_even(score + noise, 0)')} as rating from rated"""
CTES["flat_ratings"] = flat("ratings")


# --- features -------------------------------------------------------------------------------------

def share(tests) -> str:
    return "(" + " + ".join(f"cast({t} as int)" for t in tests) + f") / {q(3.0)}"


def style_match(variant: str) -> str:
    style = "lower(style_preference)" if variant == "serve" else "style_preference"
    return case((
        (f"{style} = {q(s)}", share(
            f"({among(f'{r}_type', types)} or {among(f'{r}_primary_color', colors)})"
            for r in ROLES
        ))
        for s, (types, colors) in L.STYLE_PREFS[variant].items()
    ), q(0.5))


def material_share(materials) -> str:
    return share(among(f"lower({r}_material)", materials) for r in ROLES)


def seasonal(season: str = "season") -> str:
    return case([
        (f"{season} = 'verano'", material_share(L.SUMMER_MATERIALS)),
        (f"{season} = 'invierno'", material_share(L.WINTER_MATERIALS)),
    ], q(0.5))


THERMAL = case([
    ("temperature > 25 and not isnan(temperature)", material_share(L.SUMMER_MATERIALS)),
    ("temperature < 10", material_share(L.WINTER_MATERIALS)),
], q(0.5))
MATCHES = {
    f"{n}_match": f"cast(coalesce(top_{c} = bottom_{c}, false) as int)"
    for n, c in (("color", "primary_color"), ("material", "material"), ("pattern", "pattern"))
}


def level(role: str) -> str:
    return f"coalesce({role}_formality_level, 3)"


DIFFS = {
    f"formality_diff_{a}_{b}": f"abs({level(a)} - {level(b)})"
    for a, b in (("top", "bottom"), ("top", "shoes"), ("bottom", "shoes"))
}


def feature_map(variant: str) -> dict[str, str]:
    return {
        **MATCHES, **DIFFS, "style_match": style_match(variant),
        "seasonal_appropriateness": seasonal(
            "season" if variant == "train" else "lower(season)"
        ),
        "temp_material_match": THERMAL,
    }


def columns(mapping) -> str:
    return ", ".join(f"{e} as {n}" for n, e in mapping.items())


CTES["featured"] = f"select *, {columns(feature_map('train'))} from flat_ratings"


# --- rules ----------------------------------------------------------------------------------------

def flag(name: str, prefix: str = "") -> str:
    attribute, keywords = L.DETECTORS[name]
    return has(f"coalesce(lower({prefix}{attribute}), '')", keywords)


def rule_terms() -> dict[str, list[str]]:
    activity = "coalesce(lower(activity), '')"
    winter = "coalesce(lower(season), '') = 'invierno'"
    temp = f"(case when coalesce(temperature, 0) = 0 or isnan(temperature) then {q(20.0)} else temperature end)"
    f = {
        r: f"(case when coalesce({r}_formality_level, 0) = 0 then 3 "
           f"else {r}_formality_level end)" for r in ROLES
    }
    mean = f"(({f['top']} + {f['bottom']} + {f['shoes']}) / {q(3.0)})"
    bucket = {n: among(activity, a) for n, a in L.ACTIVITY_BUCKETS.items()}
    low = case(((bucket[n], q(L.FORMALITY_BANDS[n][0])) for n in bucket),
               q(L.FORMALITY_BANDS[L.DEFAULT_BUCKET][0]))
    high = case(((bucket[n], q(L.FORMALITY_BANDS[n][1])) for n in bucket),
                q(L.FORMALITY_BANDS[L.DEFAULT_BUCKET][1]))
    sport, date, party = bucket["sport"], bucket["date"], bucket["party"]
    formal, business = bucket["formal"], f"({bucket['office']} or {bucket['formal']})"
    sneaker, elegant = flag("sport_shoe", "shoes_"), flag("elegant_shoe", "shoes_")
    sandal, boot = flag("sandal", "shoes_"), flag("boot", "shoes_")
    gym, jeans = flag("sport_bottom", "bottom_"), flag("jeans", "bottom_")
    return {
        "formality": [case([
            (f"{mean} < {low}", f"-(({low} - {mean}) * 2)"),
            (f"{mean} > {high}", f"-(({mean} - {high}) * 2)"),
        ], q(1.0))],
        "shoes": [
            on(f"{sport} and {sneaker}", 4), on(f"{sport} and not {sneaker}", -5),
            on(f"{date} and {elegant}", 3), on(f"{date} and {sneaker}", -4),
            on(f"{date} and {sandal} and ({winter} or {temp} < 8)", -3),
            on(f"{business} and {f['shoes']} >= 4", 2), on(f"{business} and {sneaker}", -3),
            on(f"{party} and {sneaker}", -1), on(f"{party} and {elegant}", 1),
        ],
        "bottom": [
            on(f"{sport} and {gym}", 3), on(f"{sport} and {jeans}", -4),
            on(f"{formal} and {gym}", -3),
        ],
        "heat": [
            on(f"{temp} >= 28 and {flag('very_warm', 'top_')}", -2),
            on(f"{temp} >= 28 and {flag('very_warm', 'bottom_')}", -2),
            on(f"{temp} >= 28 and {boot}", -2),
        ],
        "cold": [
            on(f"{temp} <= 8 and {sandal}", -4),
            on(f"{temp} <= 8 and lower(bottom_type) in ('short', 'falda')", -3),
        ],
        "harmony": [
            on("top_primary_color is not distinct from bottom_primary_color", 0.4),
            on("bottom_primary_color is not distinct from shoes_primary_color", 0.4),
            on("top_material is not distinct from bottom_material", 0.3),
        ],
    }


RAW_BONUS = total([q(0.0), *(t for block in rule_terms().values() for t in block)])
BONUS = f"greatest({q(-6.0)}, least({q(4.0)}, {RAW_BONUS}))"


# --- candidates -----------------------------------------------------------------------------------

VIOLATES = """coalesce(len(list_filter(avoid_items, lambda term: contains(
  concat_ws(' ', coalesce(lower(g.name), ''), coalesce(lower(g.type), ''),
    coalesce(lower(g.primary_color), ''), coalesce(lower(g.pattern), ''),
    coalesce(lower(g.material), '')), lower(term)))) > 0, false)"""


def triples(requests: str) -> str:
    """Every outfit of every request, with the flat columns of an outfit."""
    sides = " ".join(
        f"join {requests}_worn {r} on {r}.request_id = q.request_id and {r}.type_group = '{r}'"
        for r in ROLES
    )
    names = ["name", "type", "primary_color", "pattern", "material", "formality_level", "role"]
    chosen = ", ".join(
        [f"{r}.garment_id as {r}_id" for r in ROLES]
        + [f"{r}.{n} as {r}_{n}" for r in ROLES for n in names]
    )
    return f"""select q.request_id, q.season, q.weather_condition, q.temperature, q.activity,
      q.formality_level as context_formality, u.body_shape, u.style_preference, u.skin_tone,
      u.gender, {chosen} from {requests} q join users u on u.user_id = q.user_id {sides}"""


def worn(requests: str) -> str:
    return f"""select q.request_id, g.*, coalesce(m.role, '') as role from {requests} q
      join garments g on g.user_id = q.user_id left join meta m on m.meta_type = g.type
      where not {VIOLATES}"""


def scored(source: str) -> str:
    ids = ", ".join(f"{r}_id" for r in ROLES)
    return f"""select *, prediction + bonus as final from (select request_id, {ids},
      {bounded(expert_score())} as prediction, {BONUS} as bonus from {source})"""


def best_of(source: str, k: int) -> str:
    return f"""select *, row_number() over (partition by request_id
      order by final desc, top_id, bottom_id, shoes_id) as rank from {source}
      qualify rank <= {k}"""


CTES["requests_worn"] = worn("requests")
CTES["triples"] = triples("requests")
CTES["scored"] = scored("triples")
CTES["checked"] = f"""select q.request_id, g.garment_id, g.type_group, {VIOLATES} as violates
  from requests q join garments g on g.user_id = q.user_id"""


# --- messages -------------------------------------------------------------------------------------

CTES["messages"] = f"""select event_id as message_id, user_id,
  {pick(fixture.MESSAGES, 'event_id', 'message')} as message,
  replace({pick(fixture.REPLIES, 'event_id', 'reply')}, '@T',
          {pick(fixture.REPLY_TEMPERATURES, 'event_id', 'degrees')}) as llm_reply
from events"""
STRIPPED = r"lower(regexp_replace(message, '^\s+|\s+$', '', 'g'))"


def greeting(message: str) -> str:
    stripped = STRIPPED.replace("message", message)
    return (
        f"coalesce(length({message}) > 0 and length({stripped}) <= {L.GREETING_MAX_LENGTH} "
        f"and not {has(stripped, L.FASHION_KEYWORDS)} "
        f"and {has(stripped, L.GREETING_KEYWORDS)}, false)"
    )


# DuckDB reads a comma before a closing bracket; JSON does not allow it.
CTES["parsed"] = f"""select *, case when not regexp_matches(json_text, ',\\s*[}}\\]]')
  then try_cast(json_text as json) end as reply,
  {greeting('message')} as is_greeting
from (select *, nullif(regexp_extract(llm_reply, '\\{{.*\\}}', 0, 's'), '') as json_text
      from messages)"""


def kind(key: str) -> str:
    return f"json_type(reply, '$.{key}')"


def plain(key: str) -> str:
    return f"json_extract_string(reply, '$.{key}')"


def missing(key: str) -> str:
    numbers = "('BIGINT', 'UBIGINT', 'DOUBLE', 'HUGEINT')"
    return f"""(case when {kind(key)} is null or {kind(key)} = 'NULL' then true
      when {kind(key)} = 'VARCHAR' then {plain(key)} = ''
      when {kind(key)} = 'BOOLEAN' then {plain(key)} = 'false'
      when {kind(key)} in {numbers} then cast({plain(key)} as double) = 0
      else {plain(key)} in ('[]', '{{}}') end)"""


def number(key: str, text_pattern: str) -> str:
    return f"""(case {kind(key)} when 'VARCHAR' then
        case when regexp_matches({plain(key)}, {q(text_pattern)})
             then try_cast(trim({plain(key)}) as double) end
      when 'BOOLEAN' then case when {plain(key)} = 'true' then {q(1.0)} else {q(0.0)} end
      when 'NULL' then null when 'ARRAY' then null when 'OBJECT' then null
      else try_cast({plain(key)} as double) end)"""


TEXT_KEYS = ["season", "weather_condition", "activity", "mood"]
D = L.DEFAULT_CONTEXT
LEVEL_READ = number("formality_level", "^[ ]*[+-]?[0-9]+[ ]*$")
# greatest() and least() skip nulls in DuckDB, so an unreadable level needs its own test.
LEVEL = f"""(case when {LEVEL_READ} is null then {D['formality_level']}
  else cast(floor(greatest({q(1.0)}, least({q(5.0)}, {LEVEL_READ}))) as int) end)"""
DEGREES = (
    f"coalesce({number('temperature', '^[ ]*[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)[ ]*$')}, "
    f"{q(D['temperature'])})"
)
TERMS = f"""(case when reply is null or {missing('avoid_items')} then cast([] as varchar[])
  when {kind('avoid_items')} = 'ARRAY' then list_transform(
    from_json(json_extract(reply, '$.avoid_items'), '["VARCHAR"]'),
    lambda x: lower(coalesce(x, 'none')))
  else [lower({plain('avoid_items')})] end)"""
USABLE = "(reply is not null and " + " and ".join(
    f"({missing(k)} or {kind(k)} = 'VARCHAR')" for k in TEXT_KEYS
) + ")"


def reading(key: str, read: str, greeting_value: str | None = None) -> str:
    default = q(D[key])
    return (
        f"case when is_greeting then {greeting_value or default} when {USABLE} then {read} "
        f"else {default} end as {key}"
    )


CTES["read"] = "select message_id, user_id, message, is_greeting, " + ", ".join([
    *(reading(k, f"lower(case when {missing(k)} then {q(D[k])} else {plain(k)} end)",
              q(L.GREETING_ACTIVITY) if k == "activity" else None)
      for k in ("season", "weather_condition")),
    reading("temperature", DEGREES),
    *(reading(k, f"lower(case when {missing(k)} then {q(D[k])} else {plain(k)} end)",
              q(L.GREETING_ACTIVITY) if k == "activity" else None)
      for k in ("activity", "mood")),
    reading("formality_level", LEVEL),
]) + f""", case when not is_greeting and {USABLE} then {TERMS}
  else cast([] as varchar[]) end as avoid_items from parsed"""
CTES["known"] = f"""select * replace (is_greeting or activity = {q(L.GREETING_ACTIVITY)} as is_greeting)
  from read where length(message) > 0
  and user_id in (select user_id from users)"""
CTES["asked"] = """select min(message_id) as request_id, user_id, season, weather_condition,
  temperature, activity, mood, formality_level, avoid_items from known where not is_greeting
  group by all"""
CTES["asked_worn"] = worn("asked")
CTES["asked_triples"] = triples("asked")
CTES["asked_scored"] = scored("asked_triples")
CTES["asked_best"] = best_of("asked_scored", 1)
CTES["shown"] = """select garment_id, name, type, primary_color, image_url, type_group
  from garments"""
CTES["answered"] = """select k.*, b.top_id, b.bottom_id, b.shoes_id, b.final from known k
  left join asked a on not k.is_greeting and a.user_id = k.user_id
    and (a.season, a.weather_condition, a.temperature, a.activity, a.mood, a.formality_level,
         a.avoid_items)
      = (k.season, k.weather_condition, k.temperature, k.activity, k.mood, k.formality_level,
         k.avoid_items)
  left join asked_best b on b.request_id = a.request_id"""
CONTEXT = ["season", "weather_condition", "temperature", "activity", "mood", "formality_level"]
CONTEXT_JSON = "to_json({" + ", ".join(f"'{c}': {c}" for c in [*CONTEXT, "avoid_items"]) + "})"


def prompt(outfit: str, rating: str) -> str:
    return (
        f"'Mensaje: ' || message || chr(10) || 'Contexto: ' || {CONTEXT_JSON} || chr(10) || "
        f"{outfit} || chr(10) || {rating}"
    )


# --- change logs ----------------------------------------------------------------------------------

CTES["all_placed"] = """select user_id, garment_id,
  row_number() over (partition by user_id order by garment_id) - 1 as pos,
  count(*) over (partition by user_id) as n from garments"""
CTES["events_placed"] = f"""select e.event_id as seq, e.user_id, e.event_type, p.garment_id
  from events e join (select user_id, any_value(n) as n from all_placed group by user_id) s
    on s.user_id = e.user_id
  join all_placed p on p.user_id = e.user_id and p.pos = {h('e.event_id', 'garment')} % s.n"""
COLOR, MATERIAL = pick(L.COLORS, "seq", "color"), pick(L.MATERIALS, "seq", "material")
LEVEL_TEXT = f"cast({h('seq', 'formality_level')} % 5 + 1 as varchar)"
SHAPE = f"{h('seq', 'shape')} % 4"
CTES["changes"] = f"""select seq,
  case when event_type = 'signup' then seq + {fixture.INSERT_OFFSET} else garment_id end
    as garment_id,
  user_id + case when event_type <> 'signup' and {h('seq', 'owner')} % 7 = 0
                 then 1 else 0 end as user_id,
  case event_type when 'signup' then 'insert' when 'error' then 'delete' else 'update' end as op,
  event_type, {COLOR} as color, {MATERIAL} as new_material, {LEVEL_TEXT} as level_text,
  {SHAPE} as shape, {pick(fixture.UPLOAD_TYPES, 'seq', 'type')} as new_type
from events_placed"""
CTES["inserted"] = """select seq, garment_id, user_id, 'nueva' as name, new_type as type,
  color as primary_color, cast(null as varchar) as pattern, cast(null as varchar) as material,
  case shape when 1 then null when 2 then cast(level_text as int) else 3 end as formality_level,
  '' as description, case when shape = 2 then 'bottom' else 'top' end as type_group,
  '' as image_url
from changes where op = 'insert' and shape <> 0"""


CTES["last_changes"] = """select garment_id, user_id,
  arg_max(color, seq) filter (event_type = 'click') as color,
  count(*) filter (event_type = 'click') as n_color,
  count(*) filter (event_type = 'view') as n_pattern,
  arg_max(new_material, seq) filter (event_type = 'purchase') as material,
  arg_max(level_text, seq) filter (event_type = 'purchase') as level_text,
  count(*) filter (event_type = 'purchase') as n_material,
  count(*) filter (op = 'delete') as n_delete
from changes where op <> 'insert' group by all"""
CTES["profile_events"] = f"""select event_id as seq, user_id, event_type,
  cast({h('event_id', 'age')} % 48 + 18 as int) as age,
  {pick(L.STYLES, 'event_id', 'style_preference')} as style,
  {pick(L.GENDERS, 'event_id', 'gender')} as gender, 'nuevo_' || event_id as username
from events"""
CTES["accounts"] = """select c_custkey as seq,
  'user' || cast(floor(c_custkey * 4 / 5) as bigint) as username,
  case when c_custkey % 97 <> 0 then 'u' || cast(floor(c_custkey * 2 / 3) as bigint)
    || '@example.com' end as email from customer"""
CTES["newcomers"] = """select row_number() over (order by seq) as nth, a.* from accounts a
  where seq % 10 <> 0 and email is not null
  and email not in (select email from accounts where seq % 10 = 0 and email is not null)
  and username not in (select username from accounts where seq % 10 = 0
                       and email is not null)"""
UPLOAD = "page_id"
BLANKS = pick(fixture.UPLOAD_BLANKS, UPLOAD, "pattern")
CTES["uploads"] = f"""select page_id as upload_id,
  case when {h(UPLOAD, 'bare')} % 5 <> 0 then
    'img' || page_id || {pick(fixture.UPLOAD_SUFFIXES, UPLOAD, 'suffix')} end as filename,
  {pick(fixture.UPLOAD_FORMALITY, UPLOAD, 'formality')} as formality_raw,
  {pick(fixture.UPLOAD_NAMES, UPLOAD, 'name')} as name,
  {pick(fixture.UPLOAD_TYPES, UPLOAD, 'type')} as type,
  {pick(L.COLORS, UPLOAD, 'primary_color')} as primary_color, {BLANKS} as pattern,
  {pick([*L.MATERIALS, ''], UPLOAD, 'material')} as material,
  case when {h(UPLOAD, 'text')} % 2 = 0 then url end as description,
  case when {h(UPLOAD, 'group')} % 3 = 0 then 'shoes' end as type_group from pages"""
EXTENSION = (
    "case when contains(filename, '.') then lower(list_extract(string_split(filename, '.'), -1)) "
    "end"
)
CTES["upload_files"] = f"""select *, {EXTENSION} as extension,
  coalesce({EXTENSION} in ('png', 'jpg', 'jpeg', 'webp'), false) as allowed from uploads"""

# --- evaluation -----------------------------------------------------------------------------------

CTES["split"] = f"select *, {h('rating_id', 'split')} % 5 = 0 as is_test from ratings"
CTES["folded"] = f"""select rating_id, rating, cast((row_number() over (partition by rating
  order by {h('rating_id', 'fold')}, rating_id) - 1) % 5 as int) as fold from ratings"""
CTES["guesses"] = """select t.rating as actual, b.baseline, b.predicted from split t
  cross join (select unnest(['mean', 'median']) as baseline,
                     unnest([avg(rating), median(rating)]) as predicted
              from split where not is_test) b where t.is_test"""
CTES["fold_scores"] = """select f.fold, count(*) as n,
  avg(abs(f.rating - m.predicted) / f.rating) as mape, avg(abs(f.rating - m.predicted)) as mae
from folded f join (select a.fold, avg(b.rating) as predicted
                    from (select distinct fold from folded) a join folded b on b.fold <> a.fold
                    group by a.fold) m on m.fold = f.fold group by f.fold"""
CTES["predicted"] = f"""select r.rating_id, r.rating, {bounded('d.score')} as prediction
  from ratings r join rated d on d.rating_id = r.rating_id"""


# --- queries --------------------------------------------------------------------------------------

SQL: dict[str, str] = {}
GARMENT = """garment_id, user_id, name, type, primary_color, pattern, material,
  formality_level, description, type_group, image_url"""
SQL["scan_users"] = "select * from users"
SQL["profile_projection"] = """select user_id, u.username as username, email, age, body_shape,
  style_preference, skin_tone, gender from users u join accounts a on a.seq = u.user_id"""
SQL["scan_csv"] = """select garment_id, user_id, nullif(name, '') as name, nullif(type, '') as type,
  nullif(primary_color, '') as primary_color, nullif(pattern, '') as pattern,
  nullif(material, '') as material, formality_level, nullif(description, '') as description,
  nullif(type_group, '') as type_group, nullif(image_url, '') as image_url from garments"""
SQL["garments_by_user"] = f"""select {GARMENT} from garments
  where user_id in (select user_id from requests)"""
SQL["request_user_join"] = """select request_id, user_id, age, body_shape, style_preference,
  gender, skin_tone from requests join users using (user_id)"""
SQL["context_log"] = f"""select 'stored' as source, context_id as source_id, user_id,
  {', '.join(CONTEXT)} from contexts union all
  select 'message', message_id, user_id, {', '.join(CONTEXT)} from known where not is_greeting"""
SQL["garment_insert_defaults"] = "select * from inserted"
SQL["garment_form_clean"] = """select upload_id, name, type, primary_color,
  nullif(pattern, '') as pattern, nullif(material, '') as material,
  case when regexp_matches(formality_raw, '^[ ]*[0-9]+[ ]*$')
    then cast(trim(formality_raw) as int) else 3 end as formality_level,
  coalesce(description, '') as description, coalesce(type_group, 'top') as type_group,
  extension as image_extension from upload_files
  where name <> '' and (filename is null or allowed)"""
SQL["garment_apply_changes"] = """select g.garment_id, g.user_id, name, type,
  case when n_color > 0 then c.color else primary_color end as primary_color,
  case when n_pattern > 0 then null else pattern end as pattern,
  case when n_material > 0 then c.material else g.material end as material,
  case when n_material > 0 then cast(c.level_text as int) else formality_level end
    as formality_level, description, type_group, image_url
from (select * from garments union all select * exclude (seq) from inserted) g
left join last_changes c on c.garment_id = g.garment_id and c.user_id = g.user_id
where coalesce(n_delete, 0) = 0"""
SQL["garment_delete"] = """select garment_id, user_id, name from garments g where not exists
  (select 1 from changes c where c.op = 'delete' and c.garment_id = g.garment_id
   and c.user_id = g.user_id)"""
SQL["register_dedupe"] = """select seq, username, email from walk where ok"""
SQL["profile_apply_changes"] = """select u.user_id,
  coalesce(c.username, u.username) as username, coalesce(c.age, u.age) as age,
  case when n_view > 0 then null else u.body_shape end as body_shape,
  coalesce(c.style, u.style_preference) as style_preference, u.skin_tone,
  coalesce(c.gender, u.gender) as gender
from users u left join (select user_id,
    arg_max(username, seq) filter (event_type = 'purchase') as username,
    arg_max(gender, seq) filter (event_type = 'purchase') as gender,
    arg_max(age, seq) filter (event_type = 'signup') as age,
    arg_max(style, seq) filter (event_type = 'click') as style,
    count(*) filter (event_type = 'view') as n_view
  from profile_events group by user_id) c on c.user_id = u.user_id"""
SQL["image_ext_filter"] = "select upload_id, filename, extension, allowed from upload_files"
SQL["classify_garments"] = f"select garment_id, type, {group_of('type')} as type_group from garments"
SQL["garment_meta_lookup"] = f"""select garment_id, type, coalesce(role, '') as role,
  cast(coalesce(base_formality, {h('garment_id', 'base')} % 5 + 1) as int) as base_formality
  from garments left join meta on meta_type = type"""
SQL["wardrobe_fallback_lookup"] = """select user_id, style_preference, gender, palette_gender,
  array_to_string(types, ',') as types from user_palettes"""
SQL["off_palette_colors"] = """select user_id, array_to_string(off_colors, ',') as off_colors
  from user_palettes"""
SQL["user_wardrobe_nested"] = """select user_id, cast(pos // 50 as int) as page,
  cast(count(*) as int) as n, string_agg(garment_id, ',' order by garment_id) as garment_ids
  from all_placed group by 1, 2"""
SQL["wardrobe_counts"] = "select * from counts"
SQL["users_complete_wardrobe"] = """select user_id from counts
  where n_top > 0 and n_bottom > 0 and n_shoes > 0"""
SQL["users_generate"] = "select * from made_users"
SQL["garments_generate"] = "select * from made_garments"
SQL["contexts_generate"] = "select * from made_contexts"
SQL["ratings_generate"] = "select * from ratings"
SQL["ratings_dedupe"] = """select min(rating_id) as rating_id, user_id, context_id,
  top_garment_id, bottom_garment_id, shoes_garment_id from attempts group by all"""
SQL["ratings_limited"] = f"""select min(rating_id) as rating_id, user_id, context_id,
  top_garment_id, bottom_garment_id, shoes_garment_id from attempts where rating_id in (
    select rating_id from (select context_id * 10 + unnest([0, 1, 2]) as rating_id from contexts)
    order by rating_id limit {L.MAX_ATTEMPTS})
  group by all order by 1 limit {L.MAX_RATINGS}"""
SQL["expert_rating_parts"] = "select rating_id, " + ", ".join(
    r6(total(terms), part) for part, terms in expert_terms().items()
) + " from rated"
SQL["expert_rating"] = f"""select rating_id, {r6('score', 'score')}, {r6('noise', 'noise')},
  {bounded('round_even(score + noise, 0)')} as rating from rated"""
FULL = "* exclude (top_role, bottom_role, shoes_role) rename (context_formality as formality_level)"
SQL["full_dataset"] = f"select {FULL} from flat_ratings"
SQL["dataset_shape"] = """select count(*) as n_rows, 46 as n_columns,
  'rating_id,user_id,context_id,top_garment_id,bottom_garment_id,shoes_garment_id,rating,'
  || 'username,age,body_shape,style_preference,skin_tone,gender,season,weather_condition'
  as first_columns from flat_ratings"""
SQL["match_features"] = f"select rating_id, {columns(MATCHES)} from flat_ratings"
SQL["formality_diffs"] = f"select rating_id, {columns(DIFFS)} from flat_ratings"
for variant_ in ("train", "serve"):
    SQL[f"style_match_{variant_}"] = (
        f"select rating_id, {r6(style_match(variant_), 'style_match')} from flat_ratings"
    )
SQL["seasonal_fit"] = (
    f"select rating_id, {r6(seasonal(), 'seasonal_appropriateness')} from flat_ratings"
)
SQL["temp_material_fit"] = (
    f"select rating_id, {r6(THERMAL, 'temp_material_match')} from flat_ratings"
)
SHARES = ["style_match", "seasonal_appropriateness", "temp_material_match"]
SQL["full_features"] = "select rating_id, " + ", ".join(
    [*MATCHES, *DIFFS, *(r6(s, s) for s in SHARES), *(f"{r}_description" for r in ROLES)]
) + " from featured"
SQL["feature_matrix"] = "select " + ", ".join(
    r6(c, c) if c in SHARES else c
    for c in [*L.NUMERIC_FEATURES, *L.CATEGORICAL_FEATURES, "rating"]
) + " from featured"
SQL["garment_flags"] = "select garment_id, " + ", ".join(
    f"{flag(n)} as {n}" for n in L.DETECTORS
) + " from garments"
SQL["rule_bonus_parts"] = "select rating_id, " + ", ".join(
    r6(total(terms), part) for part, terms in rule_terms().items()
) + " from flat_ratings"
SQL["rule_bonus"] = (
    f"select rating_id, {r6(RAW_BONUS, 'raw_bonus')}, {r6(BONUS, 'bonus')} from flat_ratings"
)
SQL["candidate_triples"] = """select request_id, count(*) as n_outfits,
  sum(top_formality_level + bottom_formality_level + shoes_formality_level) as sum_formality
  from triples group by request_id"""
SQL["candidate_features"] = "select request_id, count(*) as n_outfits, " + ", ".join(
    r6(f"cast(sum({e}) as double)", f"sum_{n}") for n, e in feature_map("serve").items()
) + " from triples group by request_id"
SQL["avoid_filter"] = "select request_id, garment_id, violates from checked"
SQL["avoid_skipped_count"] = """select request_id, n_outfits, n_kept,
  n_outfits - n_kept as n_skipped from (select request_id,
    count(*) filter (type_group = 'top') * count(*) filter (type_group = 'bottom')
      * count(*) filter (type_group = 'shoes') as n_outfits,
    count(*) filter (type_group = 'top' and not violates)
      * count(*) filter (type_group = 'bottom' and not violates)
      * count(*) filter (type_group = 'shoes' and not violates) as n_kept
  from checked group by request_id)"""
SQL["score_requests"] = f"""select request_id, count(*) as n_outfits,
  {r6('min(final)', 'min_final')}, {r6('max(final)', 'max_final')},
  {r6('sum(final)', 'sum_final')} from scored group by request_id"""
RANKED = ", ".join([
    "top_id", "bottom_id", "shoes_id", *(r6(c, c) for c in ("prediction", "bonus", "final"))
])
SQL["best_outfit"] = f"select request_id, {RANKED} from ({best_of('scored', 1)})"
SQL["stream_recommend"] = SQL["best_outfit"]
SQL["top3_outfits"] = f"select request_id, rank, {RANKED} from ({best_of('scored', 3)})"
LINES = " || chr(10) || ".join(
    f"'{r}: ' || {r}.name || ' (' || {r}.type || ', ' || {r}.primary_color || ')'" for r in ROLES
)
SQL["recommend_response"] = f"""select message_id,
  case when is_greeting then 'greeting' when final is not null then 'ok' else 'no_outfit' end
    as status, round(final, 2) as predicted_rating,
  {', '.join(f'{r}.garment_id as {r}_id, ' + ', '.join(
      f'{r}.{c} as {r}_{c}' for c in ('name', 'type', 'primary_color', 'image_url',
                                      'type_group')) for r in ROLES)},
  case when not is_greeting then {prompt(
      f"case when final is null then {q(text.NO_OUTFIT_LINE)} else {LINES} end",
      f"case when final is null then {q(text.NO_RATING_LINE)} "
      "else 'Puntuación: ' || printf('%.2f', final) end")} end as reply_prompt,
  case when is_greeting then {q(text.GREETING_REPLY)} end as fixed_reply
from answered {' '.join(f'left join shown {r} on {r}.garment_id = {r}_id' for r in ROLES)}"""
SQL["greeting_flag"] = f"""select source, text_id, {greeting('text')} as is_greeting from (
  select 'conversation' as source, conv_id * 1000 + turn as text_id, text from conversations
  union all select 'message', message_id, message from messages)"""
SQL["json_extract"] = """select message_id, json_text, reply is not null as is_valid
  from parsed"""
SQL["context_normalize"] = f"""select message_id, is_greeting, {', '.join(CONTEXT)},
  array_to_string(avoid_items, '|') as avoid_items from read"""
SQL["avoid_normalize"] = """select message_id, cast(len(terms) as int) as n_terms,
  array_to_string(terms, '|') as terms from (select message_id, """ + TERMS + """ as terms
  from parsed)"""
SQL["prompt_build"] = f"""select message_id,
  replace({q(text.EXTRACTION_PROMPT)}, '%s', message) as extraction_prompt,
  {prompt(q(text.NO_OUTFIT_LINE), q(text.NO_RATING_LINE))} as reply_prompt from read"""
SQL["train_test_split"] = "select rating_id, is_test from split"
SQL["stratified_folds"] = "select rating_id, rating, fold from folded"
SQL["baseline_mean_median"] = f"""select {r6('avg(rating)', 'mean_rating')},
  {r6('median(rating)', 'median_rating')} from split where not is_test"""
SQL["baseline_metrics"] = f"""select baseline, count(*) as n,
  {r6('avg(abs(actual - predicted))', 'mae')},
  {r6('avg(abs(actual - predicted) / actual)', 'mape')},
  {r6('sqrt(avg((actual - predicted) ** 2))', 'rmse')},
  {r6('1 - sum((actual - predicted) ** 2) / (var_pop(actual) * count(*))', 'r2')}
  from guesses group by baseline"""
SQL["cv_fold_metrics"] = f"""select cast(fold as varchar) as fold, n, {r6('mape', 'mape')},
  {r6('mae', 'mae')} from fold_scores union all
  select 'mean', cast(sum(n) as bigint), {r6('avg(mape)', 'mape')}, {r6('avg(mae)', 'mae')}
  from fold_scores"""
SQL["scaler_stats"] = " union all ".join(
    f"select '{c}' as feature, {r6(f'avg(cast({c} as double))', 'mean')}, "
    f"{r6(f'stddev_pop(cast({c} as double))', 'std')} from featured" for c in L.NUMERIC_FEATURES
)
SQL["category_vocab"] = """select feature, value, cast(row_number() over (
  partition by feature order by value) - 1 as int) as position from (""" + (
    " union ".join(f"select '{c}' as feature, {c} as value from featured"
                   for c in L.CATEGORICAL_FEATURES)
) + ")"
SQL["prediction_histogram"] = f"""select cast(b.bin as int) as bin,
  {r6('lo + b.bin * ((hi - lo) / 30)', 'bin_low')}, count(p.bin) as n
from range(30) as b(bin) cross join (select min(prediction) as lo, max(prediction) as hi
                                     from predicted) e
left join (select cast(least(floor((prediction - lo) * 30 / (hi - lo)), 29) as int) as bin
           from predicted cross join (select min(prediction) as lo, max(prediction) as hi
                                      from predicted)) p on p.bin = b.bin
group by b.bin, lo, hi"""
SQL["actual_vs_predicted"] = f"""select rating, count(*) as n,
  {r6('avg(prediction)', 'mean_prediction')}, {r6('min(prediction)', 'min_prediction')},
  {r6('max(prediction)', 'max_prediction')},
  (select round(corr(rating, prediction), 6) from predicted) as correlation
from predicted group by rating"""

# Registrations are accepted one after the other, so this table walks them in order.
WALK = """walk(nth, seq, username, email, ok, emails, names) as (
  select cast(0 as bigint), cast(null as bigint), cast(null as varchar), cast(null as varchar),
    false, cast([] as varchar[]), cast([] as varchar[])
  union all
  select n.nth, n.seq, n.username, n.email,
    not list_contains(w.emails, n.email) and not list_contains(w.names, n.username),
    case when not list_contains(w.emails, n.email) and not list_contains(w.names, n.username)
      then list_append(w.emails, n.email) else w.emails end,
    case when not list_contains(w.emails, n.email) and not list_contains(w.names, n.username)
      then list_append(w.names, n.username) else w.names end
  from walk w join newcomers n on n.nth = w.nth + 1)"""


def _needed(body: str, found: list[str]) -> list[str]:
    """Names of the derived tables a text refers to, dependencies first."""
    for name in CTES:
        if name not in found and re.search(rf"\b(from|join|in|\()\s*{name}\b", body):
            _needed(CTES[name], found)
            if name not in found:
                found.append(name)
    return found


def sql(name: str) -> str:
    body = SQL[name]
    names = _needed(body, [])
    if name == "register_dedupe":
        names = _needed(WALK, [])
        tables = [f"{n} as ({CTES[n]})" for n in names] + [WALK]
        return f"with recursive {', '.join(tables)} {body}"
    tables = ", ".join(f"{n} as ({CTES[n]})" for n in names)
    return f"with {tables} {body}" if names else body


def oracle() -> dict[str, str]:
    return {name: sql(name) for name in SQL}
