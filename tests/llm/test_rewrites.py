"""Templates that change text already rendered: the rows still make the whole."""

from gridloom.llm import chat


def test_rewritten_conversations_are_whole(spark):
    def forgets(turns):  # earlier replies lose their text
        return "".join(f"[{r}]{t if r == 'user' or i == len(turns) - 1 else ''};" for i, (r, t) in enumerate(turns))

    def drops(turns):  # only the last 20 turns
        return "".join(f"[{r}]{t};" for r, t in turns[-20:])

    rows = [(c, i, "assistant" if i % 2 else "user", f"t{i}") for c in (1, 2) for i in range(41)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    for template in (chat.Template(forgets), chat.Template(forgets, 1), chat.Template(drops)):
        parts = chat.format_conversations(df, template).orderBy("conv_id", "place").collect()
        for c in (1, 2):
            own = [p for p in parts if p.conv_id == c]
            assert "".join(p.formatted for p in own) == template.render([r[2:] for r in rows if r[0] == c])
            assert [(p.rewritten_at >= 0, p.spans, len(p.roles)) for p in own] == [(True, [], 41)]
    assert chat.Template().looks_back == 0


def templates():
    def wraps(turns):
        return "<s>" + "".join(f"[{r}]{t};" for r, t in turns) + "</s>"

    def last_twenty(turns):
        return "".join(f"[{r}]{t};" for r, t in turns[-20:])

    def numbered(turns):
        return "".join(f"{i}. {r}: {t}\n" for i, (r, t) in enumerate(turns))

    return wraps, last_twenty, numbered


def forty(spark):
    rows = [(1, i, "assistant" if i % 2 else "user", f"t{i}") for i in range(40)]
    return [r[2:] for r in rows], spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")


def test_templates_are_found_out(spark):
    """Wrapping, forgetting and counting templates, with no guess and with wrong ones: the rows are always the one rendering."""
    turns, df = forty(spark)
    wraps, last_twenty, numbered = templates()
    for render in (wraps, last_twenty, numbered):
        for guess in (None, 0, 1, 16, 25):
            parts = chat.format_conversations(df, chat.Template(render, guess)).orderBy("place").collect()
            assert "".join(p.formatted for p in parts) == render(turns)
            if render is last_twenty:
                assert [(p.rewritten_at, p.spans) for p in parts] == [(20, [])]
            else:
                assert all(p.rewritten_at == -1 for p in parts)
                assert [p.formatted[a:b] for p in parts for a, b in p.contents] == [t for _, t in turns]


def test_templates_of_single_turns_are_cut(spark):
    turns, df = forty(spark)
    template = chat.Template(turn=lambda t: f"<{t[0]}>{t[1]}\n")
    parts = chat.format_conversations(df, template, run=7).orderBy("place").collect()
    assert len(parts) > 4 and "".join(p.formatted for p in parts) == "".join(f"<{r}>{t}\n" for r, t in turns)


def test_nothing_is_kept_of_texts():
    chat.locate(chat.render, [("user", "x" * 10), ("assistant", "y")])
    assert chat._seen is None
