from quire.llm import preferences


def test_pairs(spark):
    turns = [
        (0, 0, "user", "Hi"), (0, 1, "assistant", "Good answer"), (1, 0, "user", "Hi"), (1, 1, "assistant", "Bad"), (1, 1, "assistant", "Bad"), (1, 2, "user", "?"),
        (2, 0, "user", "only chosen"), (5, 0, None, None), (4, None, "assistant", "late"), (4, 0, "system", "s"), (None, 0, "user", "x"), (6, 0, "user", "same"), (7, 0, "user", "same"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, prompt int")
    got = {r.pair_id: r for r in preferences.preferences(preferences.paired(df)).collect()}
    r = got[0]
    assert r.n_common == 1 and r.prompt == "<|user|>\nHi<|end|>\n"
    assert r.chosen == "<|assistant|>\nGood answer<|end|>\n" and r.rejected == "<|assistant|>\nBad<|end|>\n<|user|>\n?<|end|>\n"
    start, end = map(int, r.chosen_mask.split(":"))
    assert (r.prompt + r.chosen)[start:end] == "Good answer<|end|>\n"
    assert [(r.prompt + r.rejected)[int(a) : int(b)] for a, b in (x.split(":") for x in r.rejected_mask.split(","))] == ["Bad<|end|>\n"]
    assert got[1].rejected is None and got[1].rejected_id is None and got[1].rejected_mask is None and got[1].n_common == 0
    assert got[2].chosen == "<|system|>\ns<|end|>\n<|assistant|>\nlate<|end|>\n" and got[2].rejected == "<|unknown|>\n<|end|>\n"
    assert (got[3].n_common, got[3].chosen, got[3].rejected, got[3].chosen_mask) == (1, "", "", "")
    assert set(got) == {0, 1, 2, 3}
