from test_assembly import detect, square


def test_a_copy_with_the_envelope_of_another_room_is_taken_with_its_plan(spark):
    """The plan of 2 and 3 is like 1 only under the envelope of 3."""
    rings = {"1": square(3, 3, 8, 4.5), "2": square(6, 3, 7, 5), "3": square(6, 3, 7, 5), "4": square(30, 3, 7, 5)}
    door = [("door", (15, 5.5, 15, 5.5, 1))]  # by the plan of 2 and 3 only, so that 1 is surer
    loops = {k: ("s", "primary", r) for k, r in rings.items()}
    got, _ = detect(spark, loops, [("1", "shaft"), ("2", "own"), ("3", "shaft"), ("4", "far")], door)
    assert {k: r.outcome for k, r in got.items()} == {"1": "valid", "2": "duplicate", "3": "copy", "4": "valid"}
    apart, _ = detect(spark, loops, [("1", "shaft"), ("2", "own"), ("3", "own"), ("4", "far")], door)
    assert {k: r.outcome for k, r in apart.items()} == {"1": "valid", "2": "valid", "3": "copy", "4": "valid"}
