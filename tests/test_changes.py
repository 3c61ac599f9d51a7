from __future__ import annotations

import random

from pyspark.sql import functions as F

from perchero import schemas as S
from perchero.operators import changes as C
from perchero.sources.storage import write_table

LOG = "seq long, garment_id long, user_id long, op string, payload map<string,string>"


def garments(spark):
    rows = [
        (1, 7, "camisa azul", "camisa", "azul", "liso", "lino", 3, "d", "top", "u"),
        (2, 7, "falda", "falda", "rojo", None, None, None, None, "bottom", ""),
    ]
    return spark.createDataFrame(rows, S.GARMENTS)


def test_insert_defaults(spark):
    full = {"name": "n", "type": "t", "primary_color": "c"}
    log = spark.createDataFrame([
        (1, 10, 7, "insert", full),
        (2, 11, 7, "insert", {**full, "formality_level": None, "type_group": "shoes"}),
        (3, 12, 7, "insert", {"name": "n", "type": "t"}),
        (4, 13, 7, "insert", {**full, "primary_color": None, "formality_level": "5"}),
    ], LOG)
    rows = {r.garment_id: r for r in C.inserted_garments(log).collect()}
    assert sorted(rows) == [10, 11]  # the table requires the colour of 13
    assert rows[10].formality_level == 3 and rows[10].type_group == "top"
    assert rows[10].description == "" and rows[10].image_url == "" and rows[10].pattern is None
    assert rows[11].formality_level is None and rows[11].type_group == "shoes"


def test_apply_changes(spark):
    full = {"name": "n", "type": "t", "primary_color": "c"}
    log = spark.createDataFrame([
        (1, 1, 7, "update", {"primary_color": "verde", "pattern": "rayas"}),
        (2, 1, 7, "update", {"primary_color": "negro"}),
        (3, 1, 7, "update", {"pattern": None, "formality_level": "5"}),
        (4, 1, 8, "update", {"material": "seda"}),     # not the owner
        (5, 2, 8, "delete", None),                     # not the owner
        (6, 10, 7, "update", {"name": "too early"}),   # before the insert
        (7, 10, 7, "insert", full),
        (8, 10, 7, "update", {"material": "lana"}),
        (9, 11, 7, "insert", full),
        (10, 11, 7, "delete", None),
        (11, 11, 7, "update", {"name": "gone"}),
        (12, 1, 7, "update", {"name": None, "material": "seda"}),  # refused as a whole
    ], LOG)
    rows = {r.garment_id: r for r in C.apply_garment_changes(garments(spark), log).collect()}
    assert sorted(rows) == [1, 2, 10]
    one = rows[1]
    assert (one.primary_color, one.pattern, one.formality_level, one.material) == (
        "negro", None, 5, "lino")
    assert rows[10].name == "n" and rows[10].material == "lana"
    left = C.delete_garments(garments(spark), spark.createDataFrame([
        (1, 1, 7, "delete", None), (2, 2, 9, "delete", None)], LOG))
    assert [r.garment_id for r in left.collect()] == [2]


def test_profiles(spark):
    users = spark.createDataFrame([(1, "a", 20, "pera", "urbano", "fría", "mujer"),
                                   (2, "b", None, None, None, None, None)], S.USERS)
    log = spark.createDataFrame([
        (1, 1, {"age": "33", "gender": "otro"}), (2, 1, {"age": "34"}),
        (3, 1, {"body_shape": None, "email": "x"}), (4, 9, {"age": "1"}),
    ], "seq long, user_id long, payload map<string,string>")
    rows = {r.user_id: r for r in C.apply_profile_changes(users, log).collect()}
    assert (rows[1].age, rows[1].gender, rows[1].body_shape) == (34, "otro", None)
    assert rows[2].username == "b" and len(rows) == 2


def test_usernames_are_held_by_one_user_at_a_time(spark):
    """Against a walk through the changes in order."""
    rng = random.Random(8)
    n = 40
    users = [(i, f"n{i % 30}" if i < 30 else f"m{i}") for i in range(n)]
    log = []
    for seq in range(1, 260):
        payload = {"age": str(seq)}
        if rng.random() < 0.8:
            payload["username"] = rng.choice([None, "n1", *(f"n{j}" for j in range(12)), f"new{seq % 9}"])
        log.append((seq, rng.choice([0, 1, 2, 3, 4, 5, rng.randrange(n), 99]), payload))
    # owners hand a name on: one leaves, the next takes it
    log += [(1000 + 2 * i, 20 + i, {"username": f"left{i}"}) for i in range(8)]
    log += [(1001 + 2 * i, 21 + i, {"username": f"n{20 + i}"}) for i in range(7)]
    names, ages = dict(users), {}
    for seq, user, payload in sorted(log, key=lambda r: r[0]):
        if user in names:
            if "username" in payload:
                name = payload["username"]
                if name is None or any(v == name for u, v in names.items() if u != user):
                    continue
                names[user] = name
            ages[user] = payload.get("age", ages.get(user))
    frame = spark.createDataFrame([(i, u, None, None, None, None, None) for i, u in users], S.USERS)
    changes = spark.createDataFrame(log, "seq long, user_id long, payload map<string,string>")
    got = {r.user_id: (r.username, r.age) for r in C.apply_profile_changes(frame, changes.repartition(3)).collect()}
    assert got == {u: (names[u], int(ages[u]) if ages.get(u) else None) for u, _ in users}


def test_a_long_chain_of_registrations(spark, monkeypatch):
    """Ten thousand rows that each collide with the one before: tens of written tables, not thousands."""
    written = []
    monkeypatch.setattr(C, "write_table", lambda table, path: written.append(path) or write_table(table, path))
    rows = [(i, f"u{i // 2}", f"e{(i + 1) // 2}") for i in range(10_000)]
    frame = spark.createDataFrame(rows, "seq long, username string, email string").repartition(4)
    got = sorted(r.seq for r in C.accept_registrations(frame, frame.limit(0).drop("seq")).collect())
    assert got == list(range(0, 10_000, 2)) and len(written) < 50


def test_form_uploads(spark):
    schema = ("upload_id long, filename string, formality_raw string, name string, type string,"
              "primary_color string, pattern string, material string, description string,"
              "type_group string")
    rows = [
        (1, "a.JPG", " 4 ", "n", "t", "c", "", "lana", None, None),
        (2, None, None, "n", "t", "c", "liso", "", "d", ""),
        (3, "a.gif", "3", "n", "t", "c", "", "", "", "top"),
        (4, "", "5.0", "n", "t", "c", "", "", "", "top"),
        (5, None, "3", "", "t", "c", "", "", "", "top"),
        (6, None, "3", "n", None, "c", "", "", "", "top"),
    ]
    got = {r.upload_id: r for r in C.clean_form_uploads(
        spark.createDataFrame(rows, schema)).collect()}
    assert sorted(got) == [1, 2, 4]
    assert (got[1].formality_level, got[1].pattern, got[1].material) == (4, None, "lana")
    assert got[1].image_extension == "jpg" and got[1].type_group == "top"
    assert got[2].formality_level == 3 and got[2].type_group == ""
    assert got[4].formality_level == 3 and got[4].image_extension is None


def test_registrations_equal_the_sequential_walk(spark):
    rng = random.Random(5)
    rows = [
        (i, rng.choice([None] + [f"n{j}" for j in range(25)]),
         rng.choice([None] + [f"e{j}" for j in range(25)])) for i in range(120)
    ]
    # A chain in which every row collides with its neighbours.
    rows += [(1000 + i, f"c{(i + 1) // 2}", f"d{i // 2}") for i in range(12)]
    existing = [("n3", "old1"), ("old2", "e4")]
    names, emails = {n for n, _ in existing}, {e for _, e in existing}
    wanted = []
    for seq, name, email in rows:
        if name and email and name not in names and email not in emails:
            wanted.append(seq)
            names.add(name)
            emails.add(email)
    got = C.accept_registrations(
        spark.createDataFrame(rows, "seq long, username string, email string"),
        spark.createDataFrame(existing, "username string, email string"),
    )
    assert sorted(r.seq for r in got.collect()) == wanted
    none = spark.createDataFrame([], "seq long, username string, email string")
    assert C.accept_registrations(none, none.drop("seq")).count() == 0


def test_one_email_may_hold_most_rows(spark):
    rows = spark.range(3000).select(
        F.col("id").alias("seq"), F.concat(F.lit("n"), "id").alias("username"),
        F.when(F.col("id") % 3 > 0, F.concat(F.lit("e"), "id")).otherwise("hot").alias("email"),
    )
    got = C.accept_registrations(rows, rows.limit(0).drop("seq"))
    assert got.count() == 2001
