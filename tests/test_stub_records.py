from lumenloom.operators import grounding


def test_a_note_is_taken_apart_once(spark):
    md = "---\nrelevance: High\nspecies: [human, mouse]\ncell_types:\n  - T cell (naive)\n---\nNote of gzmb, CD44 and cd44, cd8a."
    notes = spark.createDataFrame([(1, md), (2, "no head, FOXP3"), (3, None)], "paper_id long, text string")
    sources = spark.createDataFrame([(1, "Seen  GZMB in a T cell here")], "paper_id long, text string")
    found = grounding.stub_records(notes, sources)
    rows = {r.paper_id: r for r in found.collect()}
    assert [g.symbol for g in rows[1].genes] == ["CD8A", "GZMB"] and rows[1].genes[1].source_quote == "Seen GZMB in a T cell here"
    assert rows[1].species == ["human", "mouse"] and rows[1].cell_types[0].source_quote == "Seen GZMB in a T cell here"
    assert [m.marker for m in rows[1].surface_markers] == ["CD44"] and [g.symbol for g in rows[2].genes] == ["FOXP3"]
    # the block is cut out once for all fields, and no pattern is made anew for a row
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count(r"(?s)^---\s*\n(.*?)\n---\s*\n?(.*)$, 1)") == 1
