"""Neighbours of faces through blocks of cells, against brute force."""

import math
import random

from pyspark.sql import functions as F

from lathwork.operators import faces


def test_near_faces_move_once(spark):
    r = random.Random(11)
    rows = []
    for i in range(400):
        x, y, z = r.uniform(-30, 30), 0.0, r.uniform(-30, 30)
        rows.append((i % 2, str(i), x, x + r.choice([0.2, 1.0, 9.0]), y, y + 2.0, z, z + r.choice([0.2, 1.0, 9.0])))
    df = spark.createDataFrame(rows, "model int, id string, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    cells = [faces._cell(F.col(f"{a}{k}")).alias(f"c{a}{k}") for a in "xz" for k in "01"]
    others = df.where("id % 3 = 0").select("*", *cells)
    got = {x.id for x in faces._near(df, others, F.col("f.y0") <= F.col("o.y1"), "_n").collect()}
    cell = lambda v: math.floor(v / faces.CELL)
    want = set()
    for f in rows:
        cx, cz = cell((f[2] + f[3]) / 2), cell((f[6] + f[7]) / 2)
        for o in rows:
            if int(o[1]) % 3 == 0 and o[0] == f[0] and o[1] != f[1] and cell(o[2]) - 1 <= cx <= cell(o[3]) + 1 and cell(o[6]) - 1 <= cz <= cell(o[7]) + 1:
                want.add(f[1])
    assert got == want and 0 < len(want) < len(rows)
    at = [faces._cell(faces.middle(a)) for a in "xxzz"]
    assert faces._in_blocks(df, *at).count() == len(rows)


def test_a_wall_at_the_threshold_counts_as_in_sql(spark):
    # 0.36 of 1.05 square metres lie in the room: 0.35 of the share is 0.12 and the last bit decides
    room = spark.createDataFrame([(3.0, 5.4, 0.0, 2.0)], "x0 double, x1 double, z0 double, z1 double").alias("r")
    wall = spark.createDataFrame([(3.0, 10.0, 1.0, 1.15)], "x0 double, x1 double, z0 double, z1 double").alias("w")
    got = room.crossJoin(wall).select(faces.wall_adjacency("r", "w").alias("a")).first().a
    share = (5.4 - 3.0) * (1.15 - 1.0) / ((10.0 - 3.0) * (1.15 - 1.0))
    assert got == share * 0.35 and got > 0.12
