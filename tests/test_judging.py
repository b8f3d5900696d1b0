"""Generating and judging through a cache: what is called, how often, and what is kept."""

import json
import os
import uuid

import pytest
from pyspark.sql import functions as F

from evalloom.operators import judging as J
from evalloom.operators import passages
from evalloom.operators import prompting as P
from evalloom.sources import scratch

CLAIMS = J.Prompt("claims", "{question} {contexts} {answer}", ("contexts", "question", "answer"))
RUBRIC = J.Prompt("rubric", "{question} {answer} {claims_summary}", ("question", "answer"))


def new_client(folder, replies):
    # a class of its own for each, so that it travels to the tasks
    class Client:
        """Writes a file for each call; answers what is given for the first text that is in the prompt."""

        def __init__(self, folder, replies):
            self.folder, self.replies, self.seen = str(folder), replies, {}

        def __call__(self, system, user):
            with open(os.path.join(self.folder, f"{system}-{uuid.uuid4().hex}"), "w") as f:
                f.write(user)
            nth = self.seen[system, user] = self.seen.get((system, user), -1) + 1
            for part, said in self.replies[system].items():
                if part in user:
                    said = said[min(nth, len(said) - 1)] if isinstance(said, list) else said
                    if said == "busy":
                        raise J.Unavailable("busy")
                    return J.Reply(said, 10, 2)
            return J.Reply("", 10, 2)

        def calls(self, system):
            return sum(n.startswith(system) for n in os.listdir(self.folder))

    return Client(folder, replies)


def claims(*labels):
    return json.dumps({"claims": [{"text": f"c{i}", "label": label, "other": 1} for i, label in enumerate(labels)]})


GOOD = '{"relevance": 4, "helpfulness": 5, "reason": "r"}'
SCHEMA = "case_id long, question string, answer string, hits array<struct<doc_id:string,text:string>>, reference_answer string"
CACHE = "cache_key string, stage string, response string, prompt_tokens long, completion_tokens long, hits long"


def cases(spark, *answers):
    return spark.createDataFrame([(i, "q", a, [("d", "ctx")], None) for i, a in enumerate(answers)], SCHEMA)


def judge(spark, df, cache, client, rubric=RUBRIC, **more):
    out, fresh = J.judge_cases(df, cache, client, "m", CLAIMS, rubric, delays=(0.0, 0.0), **more)
    return {r.case_id: r for r in out.collect()}, out, fresh


def test_one_call_for_each_key_and_none_the_second_time(spark, tmp_path):
    client = new_client(tmp_path, {"claims": {"one": claims("supported"), "two": claims("unsupported", "irrelevant")}, "rubric": {"": GOOD}})
    empty = spark.createDataFrame([], CACHE)
    df = cases(spark, "one", "two", "one", "one", "  ", None)
    found, out, fresh = judge(spark, df, empty, client)
    assert (client.calls("claims"), client.calls("rubric")) == (2, 2)
    assert [found[i].judge.meta.claims_calls for i in range(4)] == [1, 1, 0, 0] and [found[i].judge.meta.claims_cache_hits for i in range(4)] == [0, 0, 1, 1]
    assert [c.label for c in found[1].judge.claims] == ["unsupported", "irrelevant"] and found[2].judge.rubric.relevance == 4
    assert found[4].error == found[5].error == "blank answer" and found[4].judge is None
    assert found[3].judge.meta.cache_saved_prompt_tokens == 20 and found[0].judge.meta.prompt_tokens == 20
    kept = scratch.written(J.cache_after(empty, out, fresh), "cache")
    assert sorted((r.stage, r.hits) for r in kept.collect()) == [("claims", 0), ("claims", 2), ("rubric", 0), ("rubric", 2)]
    found, out, fresh = judge(spark, df, kept, client)
    assert (client.calls("claims"), client.calls("rubric")) == (2, 2) and fresh.count() == 0
    assert all(found[i].judge.meta.claims_cache_hits == 1 for i in range(4))
    assert sorted(r.hits for r in J.cache_after(kept, out, fresh).collect()) == [1, 1, 5, 5]


def test_retries_failures_and_a_degraded_rubric(spark, tmp_path):
    replies = {"claims": {"slow": ["busy", "busy", claims("supported")], "odd": ["{", claims("supported")], "bad": '{"claims": [{"text": "", "label": "supported"}]}', "gone": "busy", "many": claims(*["supported"] * 15)}, "rubric": {"odd": '{"relevance": 6, "helpfulness": 1}', "": GOOD}}
    client = new_client(tmp_path, replies)
    found, _, fresh = judge(spark, cases(spark, "slow", "odd", "bad", "gone", "many"), spark.createDataFrame([], CACHE), client)
    assert (found[0].judge.meta.claims_calls, found[0].judge.meta.protocol_retries, found[0].error) == (3, 0, None)
    assert (found[1].judge.meta.claims_calls, found[1].judge.meta.protocol_retries) == (2, 1 + 2)
    assert found[1].judge.rubric is None and not found[1].judge.meta.rubric_enabled and found[1].judge.meta.rubric_skipped_reason == "bad relevance"
    assert found[2].judge is None and found[2].error == "bad claim 1" and found[3].error == "unavailable: busy"
    assert len(found[4].judge.claims) == 12 and found[4].judge.meta.truncated_claims == 3
    assert sorted(r.stage for r in fresh.collect()) == ["claims"] * 3 + ["rubric"] * 2
    assert client.calls("claims") == 3 + 2 + 3 + 3 + 1


def test_damaged_entries_are_asked_for_again_but_stay(spark, tmp_path):
    df = cases(spark, "one")
    key = J.claims_requests(df, "m", CLAIMS).first().cache_key
    cache = spark.createDataFrame([(key, "claims", '{"claims": [{"text": "x", "label": "maybe"}]}', 1, 1, 4)], CACHE)
    client = new_client(tmp_path, {"claims": {"": claims("supported")}, "rubric": {}})
    found, out, fresh = judge(spark, df, cache, client, rubric=None)
    assert found[0].judge.meta.claims_calls == 1 and found[0].judge.meta.rubric_skipped_reason == "not asked for"
    assert [(r.response[:12], r.hits) for r in J.cache_after(cache, out, fresh).collect()] == [('{"claims": [', 4)]
    more, _, _ = judge(spark, df, cache, client, rubric=None, most_claims=3)
    assert J.claims_requests(df, "m", CLAIMS, most_claims=3).first().cache_key != key and more[0].judge.meta.max_claims == 3


def test_answers_are_trimmed_and_asked_for_again(spark, tmp_path):
    client = new_client(tmp_path, {"s": {"first": [" \n", " yes \n"], "never": "  ", "q": "ok"}})
    df = spark.createDataFrame([(1, "first", []), (2, "never", []), (3, "q", [("d", "x" * 50), ("e", "y" * 9000)])], "case_id long, question string, hits array<struct<doc_id:string,text:string>>")
    out = {r.case_id: r for r in J.generate_answers(df, client, J.Prompt("s", "{contexts} {question}"), "m", delays=()).collect()}
    assert out[1].answer == "yes" and out[1].generation.calls == 2 and out[1].generation.prompt_tokens == 20 and out[1].generation.context_chunks == 0
    assert out[2].answer is None and out[2].generation is None and out[2].error == "blank answer"
    assert (out[3].generation.context_chunks, out[3].generation.dropped_contexts) == (1, 1)


@pytest.mark.parametrize(("template", "required", "said"), [("{contexts} {foo} {question}", ("contexts",), "unknown"), ("{question}", ("contexts", "question"), "lacks"), ("{contexts} {question}", ("contexts", "answer"), "lacks")])
def test_templates_are_checked(spark, template, required, said):
    with pytest.raises(ValueError, match=said):
        J.Prompt("s", template, required)
    with pytest.raises(ValueError, match=said):
        P.rendered(template, required, contexts=F.lit("c"), question=F.lit("q"))


def test_sections_of_a_template():
    assert P.split_template("# note\n[system]\nbe brief\n[user]\n{question}\n") == {"system": "\nbe brief\n", "user": "\n{question}\n"}
    assert P.split_template("no markers") == {}


def test_first_object_is_linear_and_right():
    import random
    import time

    def slow(text):
        at = text.find("{")
        while at >= 0:
            try:
                return json.dumps(json.JSONDecoder().raw_decode(text, at)[0], ensure_ascii=False, sort_keys=True)
            except ValueError:
                at = text.find("{", at + 1)
        return None

    random.seed(3)
    parts = ["{", "}", '"', "a", ":", "1", ",", "[", "]", "\\", " ", '{"a":', '"b":', "{}", "null"]
    for _ in range(20_000):
        text = "".join(random.choice(parts) for _ in range(random.randint(1, 14)))
        assert passages.first_object(text) == slow(text), text
    began = time.time()
    for text in ('{"a":' * 20_000, '{"a":[{"b":1},' * 6000, "{" * 100_000, '{"{' * 30_000, '{"a":' * 20_000 + "1" + "}" * 20_000):
        passages.first_object(text)
    assert time.time() - began < 5
