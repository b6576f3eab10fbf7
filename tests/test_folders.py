from stratacel.plans.folders import candidate_folders, folder_paths, folder_problems, track_certainty

TRACK = "doc_id string, track int, base string, generic boolean, suffixes int, place int"
CEL = "doc_id string, track int, frame int, order int, x int, y int, width int, height int, selector bigint"
DECISION = "doc_id string, track int, status string"
SELECTOR = "doc_id string, layer_id bigint, parent_id bigint"


def folders(spark, tracks, cels, decisions, selectors, **kw):
    return candidate_folders(spark.createDataFrame(tracks, TRACK), spark.createDataFrame(cels, CEL), spark.createDataFrame(decisions, DECISION), spark.createDataFrame(selectors, SELECTOR), **kw)


TRACKS = [("d", 0, "arm", False, 0, 0), ("d", 1, "arm", False, 1, 1), ("d", 2, "layer 2", True, 0, 2), ("d", 3, "leg", False, 0, 3)]
DECISIONS = [("d", 0, "strong"), ("d", 3, "strong"), ("d", 3, "new"), ("d", 1, "probable")]
CELS = [("d", 0, 0, 0, 0, 0, 5, 5, 10), ("d", 1, 1, 0, 0, 0, 5, 5, 11), ("d", 2, 1, 1, 30, 30, 1, 1, None), ("d", 3, 0, 2, 9, 9, 5, 5, None), ("d", 3, 1, 2, 9, 9, 5, 5, None)]
SELECTORS = [("d", 10, 1), ("d", 11, 1)]


def test_certainty(spark):
    out = track_certainty(spark.createDataFrame(TRACKS, TRACK), spark.createDataFrame(DECISIONS, DECISION))
    assert {r.track: (r.confirmed, r.uncertain) for r in out.collect()} == {0: (True, False), 1: (False, True), 2: (False, True), 3: (True, True)}


def test_a_family_that_excludes_itself_becomes_a_folder(spark):
    out = folders(spark, TRACKS, CELS, DECISIONS, SELECTORS)
    rows = {(r.anchor, tuple(r.members)): (r.complete, r.emitted, r.reason) for r in out.collect()}
    assert rows[0, (0, 1)] == (True, True, None)
    assert rows[0, (0, 2)] == (False, False, "observed_disjoint") and rows[3, (3,)] == (True, False, "co_visible") and len(rows) == 3
    assert folder_problems(out, folder_paths(out)).count() == 0
    wrong = folder_paths(out).where("track <> 1")
    assert [r.folder for r in folder_problems(out, wrong).collect()] == [0]
    kept = {(r.anchor, r.emitted, r.reason) for r in folders(spark, TRACKS, CELS, DECISIONS, SELECTORS, flat=True).collect()}
    assert (0, False, "flat") in kept


def test_nothing_to_put_anywhere(spark):
    assert folders(spark, [], [], [], []).count() == 0
    alone = folders(spark, [("d", 7, "x", True, 0, 0)], [("d", 7, 0, 0, 0, 0, 1, 1, None)], [], []).collect()
    assert [(r.anchor, r.members, r.emitted, r.reason) for r in alone] == [(7, [7], False, "no anchor")]
