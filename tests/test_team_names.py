from touchline.operators.team_names import resolve_names

TOKENS = "match_id long, frame_num long, token string, confidence double, b double, g double, r double"


def test_names_follow_colours_and_time(spark):
    red, blue, grey = (0.0, 0.0, 255.0), (255.0, 0.0, 0.0), (128.0, 128.0, 128.0)
    centers = spark.createDataFrame([(1, *red, *blue), (2, *red, *blue)], "match_id long, b0 double, g0 double, r0 double, b1 double, g1 double, r1 double")
    seen = [(1, f, t, 0.9, *c) for f in (5, 105, 205) for t, c in (("MCI", blue), ("ARS", red))]
    seen += [(1, 305, "MCI", 0.9, *grey), (1, 305, "ARS", 0.9, *grey), (1, 306, "XYZ", 0.1, *red)]  # colours say nothing: straight by weight, then name
    seen += [(1, 405, "QPR", 0.9, *grey), (1, 405, "EVE", 0.9, *grey), (1, 505, "ARS", 0.9, *red), (1, 506, "LIVE", 0.9, *red), (1, 507, "TOOLONG", 0.9, *red), (1, 508, None, 0.9, *red)]
    seen += [(2, 1, "AB", 0.5, *red), (2, 1, "CD", 0.5, *red), (3, 1, "AB", 0.5, *red), (3, 1, "CD", 0.5, *blue)]
    rows = {(r.match_id, r.window, r.cluster_id): (r.name, r.band, r.shown) for r in resolve_names(spark.createDataFrame(seen, TOKENS), centers).collect()}
    for w in (0, 1, 2):
        assert rows[1, w, 0] == ("ARS", "assign", "ARS") and rows[1, w, 1] == ("MCI", "assign", "MCI")
    assert rows[1, 3, 0] == ("ARS", "hold", "ARS") and rows[1, 3, 1] == ("MCI", "hold", "MCI")  # by agreement alone
    assert rows[1, 4, 0][:2] == ("EVE", "none") and rows[1, 4, 0][2] is None  # a new name without its colour
    assert (1, 5, 0) not in rows and (3, 0, 0) not in rows and {rows[2, 0, 0][0], rows[2, 0, 1][0]} == {"AB", "CD"}
    assert resolve_names(spark.createDataFrame([], TOKENS), centers).count() == 0
