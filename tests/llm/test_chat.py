from __future__ import annotations

import pytest
from hypothesis import given
from hypothesis import strategies as st

from tickloom.llm import chat, template
from tickloom.llm.queries import QUERIES

from .brute import sha


def test_query(spark, sf_dir):
    got = {r.conv_id: r for r in QUERIES["op1_chat_format"](spark, sf_dir).collect()}
    talk = [(r.conv_id, r.turn, r.role or "", r.text or "") for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    said = "</s>[INST] ok [/INST]"
    talk += [(-1, 0, "user", said), (-1, 1, "assistant", said)]
    assert set(got) == {t[0] for t in talk}
    for conv, r in got.items():
        turns = sorted((t for t in talk if t[0] == conv), key=lambda t: (t[1] is not None, t[1] or 0, t[2], t[3]))
        trained = "".join(t[3] for t in turns if t[2] == "assistant")
        assert (r.n_turns, r.turns_sha256) == (len(turns), sha("".join(f"{t[2]}\n{t[3]}\n" for t in turns)))
        assert (r.loss_chars, r.loss_sha256) == (len(trained), sha(trained))
        text = "".join(p for p, _ in chat.formatter()({"role": t[2], "text": t[3]} for t in turns))
        assert r.formatted_chars == len(text)


def test_whole_texts(spark, sf_dir):
    made = chat.format_conversations(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    row = next(r for r in made.collect() if r.conv_id == 0)
    assert [chat.unescape(row.formatted[s.start : s.end]) for s in row.trained] == ["a\\b[INST]<s></s>"]
    assert chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


parts = st.text(alphabet="<>s/[]INSTYROLEU\\ aé", max_size=30) | st.sampled_from(chat.CONTROLS) | st.lists(st.sampled_from([*chat.CONTROLS, "\\", "<", "["]), max_size=4).map("".join)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", "[ROLE]"]), parts), max_size=6))
def test_round_trip(turns):
    reader = chat.Reader()
    back = [t for piece, _ in chat.formatter()({"role": r, "text": x} for r, x in turns) for t in reader.feed(piece)]
    assert back == turns and not reader.held


@given(parts)
def test_escape_is_reversible_and_hides_controls(text):
    assert chat.unescape(chat.escape(text)) == text
    assert not any(c in chat.escape(text) for c in chat.CONTROLS)


def render(source, **names):
    return "".join(p for p, _ in template.compiled(source)(**names))


def test_template_language():
    assert render("{% for x in xs %}{{ loop.index }}{% if not loop.last %},{% endif %}{% endfor %}", xs=iter("abc")) == "1,2,3"
    assert render("{% set a = 'x' ~ 1 %}{{ a | upper }}") == "X1"
    assert render("a {{- ' b' -}} c") == "a bc"
    assert render("{% if 1 in [1, 2] %}y{% elif z %}n{% else %}e{% endif %}{% if 3 not in [1] %}k{% endif %}") == "yk"
    assert render("{{ m.k }}{{ m['k'] }}{{ m.none }}", m={"k": "v"}) == "vv"
    assert list(template.compiled("a{% generation %}b{% endgeneration %}c")()) == [("a", False), ("b", True), ("c", False)]


def test_constants_fold():
    tree = template.folded(template.parse("a{{ 'b' ~ 'c' }}{% if 1 == 2 %}{{ x }}{% endif %}d"), {})
    assert tree == (template.Output(template.Const("abcd")),)


@pytest.mark.parametrize("source", ["{% if x %}", "{{ x( }}", "{% endfor %}", "{% bad %}", "{{ x | nofilter }}", "{{ 'a' 'b' }}"])
def test_wrong_templates(source):
    with pytest.raises(template.TemplateError):
        template.compiled(source)


def test_sandbox():
    assert render("{{ m.__class__ }}{{ s.upper }}", m={"a": 1}, s="x") == ""
