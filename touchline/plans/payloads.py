"""Input of the payload query, for Spark and SQL alike."""

#: Payloads in the shapes that engines return, with {t} for a text and {a}, {b} for scores: pairs, boxes, objects with unequal
#: lists, mixed lists, and objects under other names.
PAYLOADS = [
    '[{"res": {"rec_texts": [{t}, {t}], "rec_scores": [{a}, {b}]}}]', '{"texts": [{t}, "second"], "scores": [{a}]}', "[{t}, {a}]", "[[[1, 2], [3, 4]], [{t}, {a}]]",
    "[[[[[1, 2], [3, 4]], [{t}, {a}]], [[[1, 2]], [{t}, {b}]]]]", '[{"texts": ["lost", {t}], "scores": [{a}]}, {"texts": [{t}], "scores": [{b}, 0.5]}]',
    '[{"texts": [{t}], "scores": [{a}]}, {"texts": "none"}, [{t}, {b}]]', '{"pages": [{"lines": {"res": {"texts": [{t}], "scores": [{b}]}}}, {"note": "n", "more": {"deep": [[[{t}, {a}]]]}}]}',
    '{"rec_texts": [], "texts": [{t}, {t}], "rec_scores": [{a}, 1.5]}', '[[["box"], [{t}, {a}], 3], [{t}, "no score"], null, {"res": []}]',
]
