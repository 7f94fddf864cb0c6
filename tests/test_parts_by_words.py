import contextlib
import io

from pyspark.sql import functions as F

from lathwork.operators import faces
from lathwork.plans import building


def test_words_are_found_as_the_patterns_find_them(spark):
    texts = ["p1 x", "x p1", "pintu", "group>p2", "j12", "aj1", "batu kali", "batukali", "", "a kusen b", "pp1", "door", "été atap", "p", "translucent", "sree"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    words = [faces.ROOF_WORDS, faces.GROUND_WORDS, faces.DOOR_WORDS, faces.PANE_WORDS, faces.FURNITURE_WORDS, faces.FRAME_PARTS_WORDS, faces.FLOOR_MATERIALS, faces.CEILING_MATERIALS]
    both = df.select("t", *(x for i, w in enumerate(words) for x in (faces._says(F.col("t"), w).alias(f"a{i}"), F.col("t").rlike(w).alias(f"b{i}"))))
    assert both.where(" or ".join(f"a{i} <> b{i}" for i in range(8))).count() == 0 and both.where("a0 or a1 or a2 or a3").count() >= 8


def test_a_face_makes_its_text_once(spark, sf_dir):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        building.model_faces(spark, sf_dir).where("part = 'walls'").select("model").explain("extended")
    assert said.getvalue().split("== Optimized Logical Plan ==")[1].split("== Physical Plan ==")[0].count("concat_ws") == 1
