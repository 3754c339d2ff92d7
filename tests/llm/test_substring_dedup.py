import re

from pyspark.sql import functions as F

from subrecon.llm import substring_dedup as sd


def brute(docs, unit="sentence", min_words=sd.MIN_WORDS):
    """{doc_id: (text, spans)} for unique ids."""
    cut, gap = re.compile(sd.UNITS[unit]), re.compile(sd.NOT_WORD)
    seen, out = set(), {}
    for i, text in sorted(docs, key=lambda x: (x[0] is not None, x[0])):
        runs, run = [], None
        for m in cut.finditer(text or ""):
            norm = gap.sub(" ", m.group().lower()).strip(" ")
            if not norm:
                continue
            if norm in seen:
                run = [run[0], m.end(), run[2] + len(norm.split(" "))] if run else [m.start(), m.end(), len(norm.split(" "))]
                continue
            seen.add(norm)
            if run:
                runs.append(run)
            run = None
        runs += [run] if run else []
        spans = [(a, b) for a, b, n in runs if n >= min_words]
        kept, at = "", 0
        for a, b in spans:
            kept, at = kept + text[at:a], b
        out[i] = (None if text is None else kept + text[at:], spans)
    return out


def got(df):
    return {r["doc_id"]: (r["text"], [tuple(s) for s in r["removed"] or []]) for r in df.collect()}


PASSAGE = "A shared passage has many words. It goes on for a while, sentence after sentence! Does it end? It ends here."


def test_against_brute_force(docs_of):
    texts = [PASSAGE, f"Before it. {PASSAGE} After it all.", f"x\n{PASSAGE.upper()}\ny", None, "", "...", "No. No. No.",
             "one two three four five six seven eight nine ten.\n" * 3, f"é漢🙂 start {PASSAGE}\n\n{PASSAGE}",
             "No stop at all " * 4000, "Yes. " + "No stop at all " * 4000]
    rows = list(enumerate(texts))
    for unit in sd.UNITS:
        assert got(sd.dedup(docs_of(rows), unit=unit)) == brute(rows, unit)


def test_long_passage_goes_and_offsets_point_at_it(docs_of):
    passage = " ".join(f"Sentence {i} of the passage says thing{i}." for i in range(12))
    clean = "This text is its own. Nothing in it is anyone else's. Yes."
    r = {x["doc_id"]: x for x in sd.dedup(docs_of([f"Own start. {passage}", f"Other start. {passage} Other end.", clean])).collect()}
    assert passage in r[0]["text"] and r[2]["text"] == clean and r[2]["removed"] is None
    text = f"Other start. {passage} Other end."
    assert r[1]["text"] == "Other start. Other end."
    assert [text[s["start"]:s["end"]].strip() for s in r[1]["removed"]] == [passage]


def test_chance_repeats_of_short_sentences_stay(docs_of):
    rows = [(0, "Yes. It rains."), (1, "Yes. Another day begins.")]
    assert got(sd.dedup(docs_of(rows)))[1] == ("Yes. Another day begins.", [])


def test_null_ids_repeated_rows_clashing_columns_empty_table(docs_of):
    d = docs_of([(None, PASSAGE), (3, PASSAGE), (5, "b " + PASSAGE), (5, "b " + PASSAGE)])
    d = d.selectExpr("*", "1 AS removed", "2 AS h1", "3 AS start", "4 AS original_chars")
    r = sd.dedup(d).collect()
    by = [(x["doc_id"], x["text"]) for x in r]
    assert (None, PASSAGE) in by and (3, "") in by and len(by) == 4
    assert len({t for i, t in by if i == 5}) == 1  # rows of one id and text are treated alike
    assert sd.dedup(docs_of([])).count() == 0


def test_a_hundred_thousand_runs_in_one_document(spark):
    """Every other unit is a repeat: each is a run, and their cost is linear."""
    import time

    n = 200_000
    rows = spark.range(n).selectExpr("1L AS __id", "2L AS __th", "cast(2 * id AS int) AS at", "cast(10 * id AS int) AS start",
                                     "cast(10 * id + 5 AS int) AS end", "cast(12 - id % 2 * 4 AS int) AS words")
    began = time.time()
    spans = sd.removable_spans(rows).collect()[0]["removed"]
    assert len(spans) == n // 2 and spans[1] == (20, 25) and time.time() - began < 60
    joined = sd.removable_spans(rows.withColumn("at", F.expr("at / 2").cast("int"))).collect()[0]["removed"]
    assert joined == [(0, 10 * n - 5)]


def test_cutting_costs_the_length_of_the_text(spark, docs_of):
    unit = [f"Sentence {i} of ten words or more that all repeat in here." for i in range(20_000)]
    own = [f"Own {i}." for i in range(20_000)]
    rows = [(1, " ".join(unit)), (2, " ".join(x for both in zip(own, unit) for x in both))]
    out = {r["doc_id"]: r for r in sd.dedup(docs_of(rows)).collect()}
    assert out[1]["text"] == rows[0][1] and len(out[2]["removed"]) == 20_000
    assert out[2]["text"] == " ".join(own) + " "
