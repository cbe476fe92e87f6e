from vislens.llm import unit_dedup

A = "One two three four five six seven."
B = "Alpha beta gamma delta epsilon zeta eta."
C = "Nothing of this sentence is anywhere else."


def spans(rows):
    return sorted((r.doc_id, r.start, r.end, r.kept_id, r.kept_start) for r in rows)


def cuts(text, ends):
    """(start, end, words, size) of what lies between the ends."""
    import re

    out, start = [], 0
    for end in [*ends, len(text)]:
        words = text[start:end].lower().split()
        if words:
            out.append((start, end, words, len(words) + len(re.findall(unit_dedup.NO_BLANKS, text[start:end])) // 2))
        start = end
    return out


def slow_units(text, least=6):
    """(start, end, whole line, words): every line, and every run of sentences that is too short without its first or its last one."""
    import re

    rows = {x[:2]: (*x[:2], True, x[2]) for x in cuts(text, [m.end() for m in re.finditer("\n", text)]) if x[3] >= least}
    found = cuts(text, [m.end() for m in re.finditer(unit_dedup.SENTENCE_END, text)])
    size = lambda i, j: sum(x[3] for x in found[i:j])
    for i in range(len(found)):
        for j in range(i + 1, len(found) + 1):
            if size(i, j) >= least:
                if size(i, j - 1) < least or size(i + 1, j) < least:
                    rows.setdefault((found[i][0], found[j - 1][1]), (found[i][0], found[j - 1][1], False, sum((x[2] for x in found[i:j]), [])))
                if size(i, j - 1) >= least and size(i + 1, j) >= least:
                    break
    return list(rows.values())


def slow(rows, least=6):
    """Brute force: the first place of each unit, by id and offset; passages within a repeated line are left to it."""
    first, again = {}, []
    for d, a, b, whole, words in sorted((d, *u) for d, t in rows for u in slow_units(t or "", least)):
        kept = first.setdefault(tuple(words), (d, a))
        if kept != (d, a):
            again.append((d, a, b, whole, kept))
    lines = [(d, a, b) for d, a, b, whole, _ in again if whole]
    within = lambda d, a, b: any(d == x and low <= a and b <= high for x, low, high in lines)
    return sorted((d, a, b, *kept) for d, a, b, whole, kept in again if whole or not within(d, a, b))


def test_repeats_equal_brute_force_and_keep_offsets(make_docs):
    rows = [
        (3, f"{A} {B}\n{C}"),
        (1, f"start in mid line {B} rest.\n{A}  \nshort line.\nshort line."),
        (2, A.upper() + "\n" + A + "\n" + "ÀÉ öä " * 3 + ".\n" + "àé öä " * 3 + "."),
        (4, "x"),
        (5, ""),
        (6, None),
        (7, f'{C[:-1]}!"** {A}'),
        (8, (A + " ") * 500),
    ]
    got = spans(unit_dedup.repeated_units(make_docs(rows, extra=True)).collect())
    assert got == slow(rows)
    texts = dict(rows)
    for d, start, end, kept, kept_start in got:
        assert texts[d][start:end].lower().split() == texts[kept][kept_start : kept_start + end - start + 3].lower().split()[: len(texts[d][start:end].split())]


def test_texts_lose_all_but_the_first(make_docs):
    docs = make_docs([(1, f"{A} {B}\nTail."), (2, f"{C}\n{A}\n{B}"), (3, A), (4, "  "), (5, None), (6, "")], extra=True)
    out = unit_dedup.drop_repeats(docs, length_col="n_chars")
    assert out.columns == docs.columns
    got = {r.doc_id: (r.text, r.n_chars) for r in out.collect()}
    assert got == {1: (f"{A} {B}\nTail.", len(f"{A} {B}\nTail.")), 2: (C + "\n", len(C) + 1), 4: ("  ", 2), 5: (None, None), 6: ("", 0)}
    assert unit_dedup.drop_repeats(docs, keep_empty=True).filter("doc_id = 3").first().text == ""


def test_rank_decides_what_is_kept(spark, make_docs):
    docs = make_docs([(1, A), (2, A), (None, A)]).withColumn("age", -__import__("pyspark.sql.functions", fromlist=["col"]).col("doc_id"))
    got = {(r.doc_id, r.kept_id) for r in unit_dedup.repeated_units(docs, rank_col="age").collect()}
    assert got == {(1, None), (2, None)}  # a null rank comes first
    got = {(r.doc_id, r.kept_id) for r in unit_dedup.repeated_units(docs.filter("doc_id is not null"), rank_col="age").collect()}
    assert got == {(1, 2)}


def test_repeated_rows_are_one_document_and_empty_tables_are_empty(make_docs):
    assert unit_dedup.repeated_units(make_docs([(1, A), (1, A)])).count() == 0
    assert spans(unit_dedup.repeated_units(make_docs([(1, A), (2, A), (2, A)])).collect()) == [(2, 0, len(A), 1, 0)]
    assert unit_dedup.repeated_units(make_docs([])).count() == 0
    assert unit_dedup.drop_repeats(make_docs([])).count() == 0


def test_lines_and_passages_of_short_sentences_are_found(make_docs):
    line = "En la de. Et en mentai. Ré le."  # 8 words, no sentence of 6
    lines = "One two three.\nFour five\n\nsix seven eight nine.\nTen."
    blankless = "這是一個沒有空格的句子它很長。"
    rows = [
        (1, f"{line}\n{A}\n{lines}\n{blankless}"),
        (2, f"{B}\n{line}\nEnd."),
        (3, f"Start of it.\n{lines.upper()}\n{C}"),
        (4, f"前{blankless[1:]}{blankless}後"),
        (5, f"{A} Ten."),
    ]
    assert spans(unit_dedup.repeated_units(make_docs(rows)).collect()) == slow(rows)
    out = unit_dedup.drop_repeats(make_docs(rows, extra=True))
    got = {r.doc_id: r.text for r in out.collect()}
    assert got == {1: rows[0][1], 2: f"{B}\nEnd.", 3: f"Start of it.\n{C}", 4: f"前{blankless[1:]}後", 5: "Ten."}


def test_a_repeated_line_is_one_span_and_its_sentences_are_not_told_of_again(make_docs):
    rows = [(1, f"{A} {B}\n{C}"), (2, f"x\n{A} {B}\ny"), (3, f"Before. {A} {B} After.")]
    got = spans(unit_dedup.repeated_units(make_docs(rows)).collect())
    assert got == slow(rows)
    assert [x[:3] for x in got if x[0] == 2] == [(2, 2, 3 + len(A) + 1 + len(B) + 0)]
    assert len([x for x in got if x[0] == 3]) == 2


def test_an_id_with_several_texts_loses_only_what_each_repeats(make_docs):
    own = "Entirely own first sentence with many words in it and more. Another of its own."
    for d in (7, None):
        rows = [(1, f"{A}\nend"), (d, f"{A} beta"), (d, own), (d, f"{own} {A}")]
        out = sorted(r.text for r in unit_dedup.drop_repeats(make_docs(rows)).collect() if r.doc_id == d)
        kept = [t for t in out if t.startswith("Entirely")]
        assert "beta" in out and own in kept if d else len(out) >= 2
        assert sum("Entirely own first sentence" in t for t in out) == 1


def test_a_unit_of_a_third_of_all_rows_is_joined_without_a_shuffle(make_docs, monkeypatch):
    monkeypatch.setattr(unit_dedup, "HOT_SHARE", 10**9)
    rows = [(i, f"{A}\nOwn words of the document number {i}.") for i in range(1500)] + [(2000, B), (2001, B)]
    got = unit_dedup.repeated_units(make_docs(rows))
    assert {r.doc_id for r in got.collect()} == {*range(1, 1500), 2001}
    assert "BroadcastHashJoin" in got._jdf.queryExecution().toString()


def test_passages_equal_all_runs_by_brute_force():
    import random

    dice = random.Random(7)
    for _ in range(200):
        text = "".join(" ".join("w%d" % dice.randrange(3) for _ in range(dice.randrange(9))) + dice.choice([".\n", ". ", "\n"]) for _ in range(8))
        want = {x[:2]: x[2] for x in slow_units(text)}
        assert {x[:2] for x in unit_dedup.lines(text)} == {k for k, whole in want.items() if whole}
        assert {x[:2] for x in unit_dedup.passages(text)} | {x[:2] for x in unit_dedup.lines(text)} == set(want)
