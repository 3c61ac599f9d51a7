"""The hand-made scenarios: three requests with 2 x 2 x 2 garments each, and their goldens."""

from __future__ import annotations

# Fixed values.
USERS = {
    1: ("romantico", "invierno", 7.0, "cita_romantica"),
    2: ("urbano", "verano", 32.0, "deporte"),
    3: ("minimalista", "primavera", 20.0, "trabajo_oficina"),
}
# User, group, type, colour, pattern, material, formality
GARMENTS = [
    (1, "top", "top_encaje", "blanco", "liso", "seda", 4),
    (1, "top", "jersey", "rosa", "punto", "lana", 3),
    (1, "bottom", "falda_midi", "rosa", "liso", "lino", 3),
    (1, "bottom", "pantalones_sastre", "negro", "liso", "poliester", 4),
    (1, "shoes", "pumps", "negro", "liso", "cuero", 4),
    (1, "shoes", "sneakers", "blanco", "liso", "sintetico", 1),
    (2, "top", "camiseta", "gris", "liso", "algodon", 1),
    (2, "top", "hoodie", "negro", "liso", "algodon", 2),
    (2, "bottom", "pantalon_corto", "negro", "liso", "poliester", 1),
    (2, "bottom", "jeans_rectos", "azul", "liso", "jean", 2),
    (2, "shoes", "sneakers", "blanco", "liso", "sintetico", 1),
    (2, "shoes", "mocasines", "marron", "liso", "cuero", 3),
    (3, "top", "camisa", "blanco", "liso", "algodon", 4),
    (3, "top", "top_liso", "beige", "liso", "algodon", 3),
    (3, "bottom", "pantalones_sastre", "negro", "liso", "poliester", 4),
    (3, "bottom", "jeans", "azul_marino", "liso", "jean", 2),
    (3, "shoes", "zapatos", "negro", "liso", "cuero", 4),
    (3, "shoes", "sneakers", "blanco", "liso", "sintetico", 1),
]
# raw bonus, (colour, material, pattern match), diffs, seasonal, temperature share
GOLDENS = {
    (1, "top_encaje", "falda_midi", "pumps"): (4.0, (0, 0, 1), (1, 0, 1), 0, 0),
    (1, "top_encaje", "falda_midi", "sneakers"): (-5.0667, (0, 0, 1), (1, 3, 2), 0, 0),
    (1, "top_encaje", "pantalones_sastre", "pumps"): (4.4, (0, 0, 1), (0, 0, 0), 0, 0),
    (1, "top_encaje", "pantalones_sastre", "sneakers"): (-4.4, (0, 0, 1), (0, 3, 3), 0, 0),
    (1, "jersey", "falda_midi", "pumps"): (4.4, (1, 0, 0), (0, 1, 1), 1 / 3, 1 / 3),
    (1, "jersey", "falda_midi", "sneakers"): (-5.3333, (1, 0, 0), (0, 2, 2), 1 / 3, 1 / 3),
    (1, "jersey", "pantalones_sastre", "pumps"): (4.4, (0, 0, 0), (1, 1, 0), 1 / 3, 1 / 3),
    (1, "jersey", "pantalones_sastre", "sneakers"): (-5.0667, (0, 0, 0), (1, 2, 3), 1 / 3, 1 / 3),
    (2, "camiseta", "pantalon_corto", "sneakers"): (5.0, (0, 0, 1), (0, 0, 0), 1, 1),
    (2, "camiseta", "pantalon_corto", "mocasines"): (-4.0, (0, 0, 1), (0, 2, 2), 2 / 3, 2 / 3),
    (2, "camiseta", "jeans_rectos", "sneakers"): (1.0, (0, 0, 1), (1, 0, 1), 2 / 3, 2 / 3),
    (2, "camiseta", "jeans_rectos", "mocasines"): (-8.0, (0, 0, 1), (1, 2, 1), 1 / 3, 1 / 3),
    (2, "hoodie", "pantalon_corto", "sneakers"): (5.4, (1, 0, 1), (1, 1, 0), 1, 1),
    (2, "hoodie", "pantalon_corto", "mocasines"): (-3.6, (1, 0, 1), (1, 1, 2), 2 / 3, 2 / 3),
    (2, "hoodie", "jeans_rectos", "sneakers"): (1.0, (0, 0, 1), (0, 1, 1), 2 / 3, 2 / 3),
    (2, "hoodie", "jeans_rectos", "mocasines"): (-9.2667, (0, 0, 1), (0, 1, 1), 1 / 3, 1 / 3),
    (3, "camisa", "pantalones_sastre", "zapatos"): (3.4, (0, 0, 1), (0, 0, 0), 0.5, 0.5),
    (3, "camisa", "pantalones_sastre", "sneakers"): (-2.0, (0, 0, 1), (0, 3, 3), 0.5, 0.5),
    (3, "camisa", "jeans", "zapatos"): (3.0, (0, 0, 1), (2, 0, 2), 0.5, 0.5),
    (3, "camisa", "jeans", "sneakers"): (-3.9333, (0, 0, 1), (2, 3, 1), 0.5, 0.5),
    (3, "top_liso", "pantalones_sastre", "zapatos"): (3.4, (0, 0, 1), (1, 1, 0), 0.5, 0.5),
    (3, "top_liso", "pantalones_sastre", "sneakers"): (-3.2667, (0, 0, 1), (1, 2, 3), 0.5, 0.5),
    (3, "top_liso", "jeans", "zapatos"): (3.0, (0, 0, 1), (1, 1, 2), 0.5, 0.5),
    (3, "top_liso", "jeans", "sneakers"): (-4.6, (0, 0, 1), (1, 2, 1), 0.5, 0.5),
}
# (serve, train) style share per garment
STYLE_HITS = {
    (1, "top_encaje"): (1, 1), (1, "jersey"): (1, 1), (1, "falda_midi"): (1, 1),
    (1, "pantalones_sastre"): (0, 0), (1, "pumps"): (0, 0), (1, "sneakers"): (0, 1),
    (2, "camiseta"): (0, 0), (2, "hoodie"): (1, 1), (2, "pantalon_corto"): (1, 1),
    (2, "jeans_rectos"): (1, 1), (2, "sneakers"): (1, 1), (2, "mocasines"): (0, 0),
    (3, "camisa"): (1, 1), (3, "top_liso"): (1, 1), (3, "pantalones_sastre"): (1, 1),
    (3, "jeans"): (0, 0), (3, "zapatos"): (1, 1), (3, "sneakers"): (1, 1),
}


def garments(spark):
    rows = [
        (100 + i, u, f"{t} de {m} {c}", t, c, p, m, f, "", g, "")
        for i, (u, g, t, c, p, m, f) in enumerate(GARMENTS)
    ]
    from perchero import schemas as S
    return spark.createDataFrame(rows, S.GARMENTS)


def users(spark):
    from perchero import schemas as S
    rows = [(u, f"user{u}", 30, "pera", s, "neutra", "mujer") for u, (s, *_) in USERS.items()]
    return spark.createDataFrame(rows, S.USERS)


def requests(spark, avoid=None):
    rows = [
        (10 + u, u, season, "templado", temp, activity, "relajado", 3, (avoid or {}).get(u, []))
        for u, (_, season, temp, activity) in USERS.items()
    ]
    return spark.createDataFrame(
        rows,
        "request_id long, user_id long, season string, weather_condition string,"
        "temperature double, activity string, mood string, formality_level int,"
        "avoid_items array<string>",
    )
