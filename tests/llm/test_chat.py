import hashlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from pathloom.llm import chat

ROWS = [
    (1, 0, "system", "Be kind."), (1, 1, "user", "a < b \\ > c"), (1, 2, "assistant", "\\< \\\\ </turn>\n<turn assistant>\nno"), (1, 3, "assistant", ""),
    (2, 5, None, None), (2, 1, "assistant", None), (3, 1, "us>er\n", "\n\n"), (3, 1, "us>er\n", "\n\n"), (3, 1, "assistant", "tie"), (4, 0, "assistant", "é😀 " * 50_000),
    (None, 0, "user", "nobody"), (None, 1, "assistant", "{{ m.role }} {% endfor %}"),
] + [(9, k, ("user", "assistant")[k % 2], f"text {k} <") for k in range(10_000)]


def expected():
    convs = defaultdict(list)
    for c, t, r, x in ROWS:
        convs[c].append((t, r or "", x or ""))
    out = []
    for c, rows in convs.items():
        rows.sort()
        said = "".join(x for _, r, x in rows if r == "assistant")
        text = "".join(f"<turn {chat.escape(r)}>\n{chat.escape(x)}\n</turn>\n" for _, r, x in rows)
        digest = hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in rows).encode()).hexdigest()
        out.append((c, len(rows), digest, len(said), hashlib.sha256(said.encode()).hexdigest(), len(text)))
    return sorted(out, key=str)


def test_round_trip(spark):
    df = spark.createDataFrame([(*r, 1, "x") for r in ROWS], "conv_id long, turn long, role string, text string, part long, loss string").orderBy(F.rand(3)).repartition(3)
    out = chat.format_conversations(df)
    assert sorted(map(tuple, chat.read_back(out).collect()), key=str) == expected()
    first = sorted((r for r in out.collect() if r.conv_id == 1), key=lambda r: r.part)
    assert len(first) == 4 and [r.formatted[s.start : s.end] for r in first for s in r.loss] == [chat.escape(ROWS[2][3]), ""]


def test_empty(spark):
    assert chat.read_back(chat.format_conversations(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).collect() == []


def rendered(template, messages):
    return "".join(t for t, _ in chat.compiled(template)(messages))


def test_language():
    m = [{"role": "a", "text": " X "}, {"role": "b", "text": None}]
    assert rendered("<{% for m in messages %}{{ m.role | upper ~ ':' ~ (m.text | trim | lower) }};{% endfor %}>", m) == "<A:x;B:;>"
    t = "{% for m in messages %}{% if m.role == 'a' and not m.text == 'y' %}1{% elif m.role != 'b' or 0 %}2{% else %}3{% endif %}{% endfor %}"
    assert rendered(t, m) == "13"
    assert rendered(r"{{ 'it\'s\n' }}{{ 12 }}", []) == "it's\n12"
    assert list(chat.compiled("a{% generation %}b{{ 'c' }}{% endgeneration %}d")([])) == [("abcd", [(1, 3)])]


def test_constants_are_folded():
    tree = chat.fold(chat.parse("a{{ 'b' | upper ~ 1 }}{% if 'x' == 'x' %}c{% else %}{{ missing }}{% endif %}d"))
    assert tree == ("block", [("text", "aB1cd")])


@pytest.mark.parametrize("bad", ["{% for m in messages %}", "{{ m.__class__.x }", "{{ a b }}", "{% endif %}", "{{ m | exec }}", "{% import os %}", "{{ f() }}", "{% if x %}{% else %}{% else %}{% endif %}", "{{ }}", "{% for m messages %}{% endfor %}"])
def test_not_of_the_language(bad):
    if bad == "{{ m.__class__.x }":
        bad = "{% for m in messages %}{{ m.__class__ }}{% endfor %}"
    with pytest.raises(chat.TemplateError):
        rendered(bad, [{"role": "a"}])


def test_messages_are_streamed():
    def endless():
        k = 0
        while True:
            k += 1
            yield {"role": "user", "text": str(k)}

    parts = chat.compiled(chat.TEMPLATE)(endless())
    assert next(parts)[0] == "<turn user>\n1\n</turn>\n" and next(parts)[0].count("2") == 1


def test_tags_end_outside_strings_and_keys_may_stand_in_brackets():
    render = chat.compiled("{{ '}}' }}{% for m in messages %}{% if m['role'] == \"%}\" %}no{% else %}{{ m['text'] ~ '{{x}}' }}{% endif %}{% endfor %}")
    assert "".join(t for t, _ in render([{"role": "user", "text": "a"}])) == "}}a{{x}}"
    with pytest.raises(chat.TemplateError):
        chat.parse("{{ m[role] }}")


def test_a_usual_template():
    template = """
{%- set name = 'bot' -%}
{% for m in messages %}
    {%- if loop.first and m['role'] != 'system' -%} <s>{{ none }}\n {%- endif -%}
    {%- set who = m.role -%}
    <|{{ who }}|>{{ loop.index ~ '/' ~ loop.index0 }} {{- m['text'] | trim }}
    {%- if not loop.last -%} <sep> {%- endif -%}
{% endfor %}
{%- if add_generation_prompt %}<|{{ name }}|>{% endif -%}
"""
    m = [{"role": "user", "text": " a - b "}, {"role": "bot", "text": "c"}]
    for asked in (True, False):
        text = "".join(t for t, _ in chat.compiled(template, {"add_generation_prompt": asked})(iter(m)))
        assert text == "<s><|user|>1/0a - b<sep><|bot|>2/1c" + "<|bot|>" * asked
    assert "".join(t for t, _ in chat.compiled(template, {"add_generation_prompt": True})([])) == "<|bot|>"
    with pytest.raises(chat.TemplateError):
        "".join(t for t, _ in chat.compiled(template)(m))


def test_set_in_a_loop_holds_for_its_round():
    template = "{% set x = 'a' %}{% for m in messages %}{{ x }}{% set x = m.text %}{{ x }}{% endfor %}{{ x }}"
    assert rendered(template, [{"text": "1"}, {"text": "2"}]) == "a1a2a"
    for bad in ("{% set x %}", "{% set 1 = 2 %}", "{% set x = %}", "{{ x = 1 }}"):
        with pytest.raises(chat.TemplateError):
            chat.compiled(bad)


def test_last_reads_one_message_ahead_only():
    read = []
    parts = chat.compiled("{% for m in messages %}{{ m.text }}{% if loop.last %}.{% endif %}{% endfor %}")({"text": str(read.append(k) or k)} for k in range(5))
    assert next(parts)[0] == "0" and read == [0, 1]
    assert "".join(t for t, _ in parts) == "1234."
