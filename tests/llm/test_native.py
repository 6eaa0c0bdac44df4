from __future__ import annotations

import hashlib
import random
import re
import textwrap
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from framequarry.llm import licenses, mixing, quality, queries, sharding, url_rules

WS = " \t\n\x0b\f\r"


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    got = con.execute(queries.oracle_sql()[name])
    cols = sorted(d[0] for d in got.description)
    order = [[d[0] for d in got.description].index(c) for c in cols]
    want = sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=str)
    df = queries.queries()[name](spark, sf_dir)
    assert sorted(df.columns) == cols
    assert sorted((tuple(r[c] for c in cols) for r in df.collect()), key=str) == want


# Quality


def slow_figures(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(f"[^{WS}]+", text)
    lines = [x for x in text.split("\n") if x.strip(WS)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n = Counter(grams)
    repeat = {p for i, g in enumerate(grams) if n[g] > 1 for p in range(i, i + 3)}
    failed = len(words) < 50 or 100 * len(repeat) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(repeat), failed


def test_quality_figures(spark):
    rng = random.Random(4)
    rows = [(i, "".join(rng.choices(["a ", "b ", "the ", "é\n", "a b c\n", "#", "\t", "<x> "], k=rng.randint(0, 300)))) for i in range(60)]
    rows += [(100, None), (101, ""), (102, " \n \x0b"), (103, "a"), (104, "a a a a"), (105, "x y z " * 3000), (None, "the cat sat"), (104, "a a a a")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kept", F.lit("clash"))
    out = quality.quality_rules(df).collect()
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert sorted(((r.doc_id, *(r[c] for c in names)) for r in out), key=str) == sorted(((i, *slow_figures(t)) for i, t in rows), key=str)
    assert not any(r.kept for r in out if r.base_failed)
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_quality_runs_without_python_or_exchange(spark, sf_dir):
    plan = queries.op5_quality_rules(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "Arrow" not in plan


def test_clean_documents_pass(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    good = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1")
    out = quality.quality_rules(docs.join(good, "doc_id"))
    assert out.where("NOT base_failed").count() > 20
    assert out.where("NOT base_failed AND NOT kept").count() == 0


def test_quality_of_very_long_texts(spark):
    rows = [(1, " " * 2_000_000 + "a"), (2, "\n \t" * 500_000), (3, "word " * 300_000), (4, "x" * 3_000_000), (5, "#" * 1_000_000), (6, ("the quick brown fox " * 3 + "\n") * 20_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert {r.doc_id: tuple(r[c] for c in names) for r in quality.quality_rules(df).collect()} == {i: slow_figures(t) for i, t in rows}


def test_passing_documents_are_those_kept(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").withColumn("n_words", F.lit("clash")).withColumn("_w", F.lit(1))
    out = quality.passing_documents(docs)
    assert out.columns == docs.columns
    assert sorted(map(tuple, out.collect())) == sorted(tuple(r) for r in docs.join(quality.quality_rules(docs.select("doc_id", "text")).where("kept").select("doc_id"), "doc_id", "left_semi").collect())


def test_quality_figures_are_made_once(spark, sf_dir):
    plan = quality.passing_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("split(") == 1 and plan.count("xxhash64(") == 1


# URLs


def slow_rule(url: str | None, rules) -> tuple:
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]), len(r[1]), r), default=None)
    return host, path, best and best[0] + best[1], best[2] if best else "allow"


@pytest.mark.parametrize("lanes", [1, 5])
def test_urls_match_brute_force(spark, lanes):
    rng = random.Random(6)
    hosts = ["net", "a.net", "NET", "example.net", "x.example.net", "xexample.net", "example.com", "m.example.com", "org", "b.org", "com", "", "net.", ".net", "a..net", "example.net:80", "netx", "a.b.c.d"]
    paths = ["", "/", "/en/", "/en/x", "/en", "/de/1", "/fr/", "/fr/?q=/x", "?/en/", "#/en/", "/EN/", "/a://b"]
    urls = [f"{s}://{h}{p}" for s in ("http", "HTTPS") for h in hosts for p in paths] + ["", "nothing", "://", "a:/b", None, None, "http://net/", "http://net/"]
    rules = [*url_rules.RULES, ("c.d", "/", "block"), ("d", "/en", "allow"), ("b.c.d", "/fr/", "allow"), ("a.b.c.d", "/", "block"), ("net", "/en/", "allow"), ("x.net", "/", "block")]
    rng.shuffle(urls)
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    out = url_rules.filter_urls(df, url_rules.rule_table(spark, rules), lanes=lanes).collect()
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in out} == {i: slow_rule(u, rules) for i, u in enumerate(urls)}
    assert len(out) == len(urls)
    none = url_rules.filter_urls(df, url_rules.rule_table(spark, rules).limit(0), lanes=lanes).collect()
    assert all(r.rule is None and r.verdict == "allow" for r in none) and len(none) == len(urls)
    assert url_rules.filter_urls(df.limit(0), url_rules.rule_table(spark)).count() == 0


def test_rules_and_sweep_are_free_of_python(spark, sf_dir):
    plan = queries.op3_url_filters(spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "ExistingRDD", "monotonically"))


def test_odd_rules(spark):
    rules = [("it's.org", "/a\\b", "block"), ("net", None, "block"), (None, "/", "block")]
    df = spark.createDataFrame([(1, "http://it's.org/a\\b/c"), (2, "http://net/"), (3, "http://x/" + "y" * 1_000_000), (4, None)], "page_id long, url string")
    out = {r.page_id: (r.rule, r.verdict, len(r.path)) for r in url_rules.filter_urls(df, url_rules.rule_table(spark, rules)).collect()}
    assert out == {1: ("it's.org/a\\b", "block", 6), 2: (None, "allow", 1), 3: (None, "allow", 1_000_001), 4: (None, "allow", 0)}
    assert url_rules.filter_urls(df, url_rules.rule_table(spark, [])).where("verdict <> 'allow'").count() == 0


# Sharding


def check_shards(out, limit: int) -> None:
    total = Counter()
    for r in out:
        total[r.shard] += r.n_bytes
    for r in out:
        assert total[r.shard] == r.shard_bytes
    names = sorted(total)
    assert all(not (b.startswith(a) and "/" not in b) for a in names for b in names if a != b)
    assert all(v <= limit or sum(r.shard == s for r in out) == 1 for s, v in total.items())


@pytest.mark.parametrize("step", [2, 12])
def test_shards_fit_and_split_only_if_needed(spark, step):
    rng = random.Random(7)
    rows = [(i, "x" * rng.randint(0, 400)) for i in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("shard", F.lit(1))
    out = sharding.extendible_shards(df, 3000, step=step).collect()
    check_shards(out, 3000)
    bits = {i: f"{int(hashlib.md5(str(i).encode()).hexdigest()[:15], 16):060b}" for i, _ in rows}
    size = dict((i, len(t)) for i, t in rows)
    for r in out:
        assert bits[r.doc_id].startswith(r.shard) and len(r.shard) == r.depth
        if r.depth:
            assert sum(size[i] for i in size if bits[i].startswith(r.shard[:-1])) > 3000


def test_directory_leads_to_each_row(spark):
    rng = random.Random(17)
    df = spark.createDataFrame([(i, "x" * rng.randint(0, 400)) for i in range(500)] + [(7, "y" * 100)] * 40, "doc_id long, text string")
    out = sharding.extendible_shards(df.withColumn("bits", sharding.slot_bits("doc_id", "text")), 2000)
    slots = sharding.directory(out).collect()
    depth = max(r.depth for r in out.collect())
    assert {r.global_depth for r in slots} == {depth}
    bounds = sorted({(r.first_slot, r.last_slot) for r in slots})
    value = [(int(a, 2), int(b, 2)) for a, b in bounds]
    assert value[0][0] == 0 and value[-1][1] == 2**depth - 1 and all(b + 1 == c for (_, b), (c, _) in zip(value, value[1:], strict=False))
    of = {r.shard: r for r in slots}
    for r in out.collect():
        assert of[r.shard].first_slot <= r.bits[:depth] <= of[r.shard].last_slot
    one = sharding.directory(sharding.extendible_shards(df, 10**7)).collect()
    assert [(r.shard, r.depth, r.global_depth, r.first_slot) for r in one] == [("", 0, 0, "")]
    assert sharding.directory(sharding.extendible_shards(df.limit(0), 10)).count() == 0


def test_shards_of_equal_and_odd_rows(spark):
    rows = [(1, "a" * 100)] * 50 + [(1, "b" * 100)] * 20 + [(2, "c" * 5000), (3, None), (None, "d"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    out = sharding.extendible_shards(df, 1000).collect()
    assert len(out) == len(rows)
    check_shards(out, 1000)
    assert sharding.extendible_shards(df.limit(0), 1000).count() == 0
    assert {r.shard for r in sharding.extendible_shards(df, 10**6).collect()} == {""}


# Licences


def test_licences(spark):
    rows = [
        (1, "Intro.\nReleased under the MIT License.\nMore text here."),
        (2, "LICENSED UNDER THE APACHE LICENSE, VERSION 2.0! You may not use this file except in compliance with the License. Other words follow. You may obtain a copy of the License at: x"),
        (3, "You may obtain a copy of the License at this place"),
        (4, None),
        (5, ""),
        (6, "Licensed under CC BY-NC 4.0. Released under the MIT License.\nReleased under the MIT License."),
        (7, "SPDX-License-Identifier: MIT\n// SPDX-License-Identifier: GPL-3.0-only"),
        (8, "Not released under the MIT License."),
        (9, "a.b. " * 200_000 + "\nAll rights\nreserved"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("licenses", F.lit(0))
    out = {r.doc_id: (r.sentence_ids, r.licenses, r.n_licenses) for r in licenses.scan_licenses(df).collect()}
    none = ("", [], 0)
    assert out == {
        **{1: ("m", ["mit"], 1), 2: ("aco", ["apache-2.0-notice"], 1), 3: none, 4: none, 5: none, 6: ("ymm", ["mit", "cc-by-nc-4.0"], 2)},
        **{7: ("mg", ["mit", "gpl-3.0"], 2), 8: none, 9: ("x", ["proprietary"], 1)},
    }
    assert licenses.scan_licenses(df.limit(0)).count() == 0


MIT = """MIT License

Copyright (c) 2020 A. Person

Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
APACHE = """Copyright 2020 A. Person

Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."""
GPL2 = GPL3.replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2")
BSD3 = """Copyright (c) 2020, A. Person
All rights reserved.

Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER BE LIABLE FOR ANY DIRECT DAMAGES."""
BSD2 = "\n\n".join(p for p in BSD3.replace("All rights reserved.\n", "").split("\n\n") if not p.startswith("3."))
PUBLISHED = {"mit-text": MIT, "apache-2.0-notice": APACHE, "gpl-3.0-notice": GPL3, "gpl-2.0-notice": GPL2, "bsd-3-clause": BSD3, "bsd-2-clause": BSD2}
WIDTHS = (55, 60, 64, 70, 72, 76, 79, 80, 90, 100)


def wrapped(text: str, width: int | None, prefix: str) -> str:
    if width is None:  # headings on lines of their own, all else on one
        parts = text.split("\n\n")
        k = next(i for i, p in enumerate(parts) if len(p) > 100)
        return "\n".join(prefix + x for x in [*"\n".join(parts[:k]).split("\n"), " ".join(" ".join(parts[k:]).split())] if x)
    lines = [x for p in text.split("\n\n") for x in [*textwrap.wrap(p, width, break_long_words=False, break_on_hyphens=False), ""]]
    return "\n".join((prefix + x).rstrip() if prefix else x for x in lines)


def slow_ids(text: str | None) -> str:
    """Known sentences by words: each is looked for from the first word on, between ends that are told from the characters themselves."""
    text = f"\n\n{text or ''}\n\n"
    found = list(re.finditer("[A-Za-z0-9]+", text))
    cut = [text[(found[k - 1].end() if k else 0) : (found[k].start() if k < len(found) else len(text))] for k in range(len(found) + 1)]
    ends, whole = [], []
    for gap in cut:
        plain = "".join(c if c in "\n.!?:;" else " " for c in gap)
        ends.append(bool(re.search(r"[.!?:;][ \n]|\n", plain)))
        whole.append(bool(re.search(r"[.!?][ \n]|\n *\n", plain)))
    known = sorted(((s.split(), i) for s, i in licenses.known_sentences().items()), key=lambda x: -len(" ".join(x[0])))
    w = [m[0].lower() for m in found]
    out, k = "", 0
    while k < len(w):
        hit = next(((s, i) for s, i in known if ends[k] and w[k : k + len(s)] == s and ends[k + len(s)] and not any(whole[k + 1 : k + len(s)])), None)
        out += hit[1] if hit else ""
        k += len(hit[0]) if hit else 1
    return out


@pytest.mark.parametrize("prefix", ["", "# ", " * ", "// ", ";; "])
def test_published_licences_wrapped_and_not(spark, prefix):
    rows = [(name, n, "Intro words.\n\n" + wrapped(t, n, prefix) + "\nMore words.") for name, t in PUBLISHED.items() for n in (*WIDTHS, None)]
    rows += [(name, -n, wrapped(t, n, prefix).replace("\n", "\r\n")) for name, t in PUBLISHED.items() for n in WIDTHS]
    rows += [(name, 1, wrapped(t, 72, prefix).replace(" ", " " * 500, 3).replace("\n", " " * 500 + "*" * 500 + "\n")) for name, t in PUBLISHED.items()]
    out = {(r.name, r.n): (r.sentence_ids, r.licenses) for r in licenses.scan_licenses(spark.createDataFrame(rows, "name string, n int, text string")).collect()}
    for name, n, text in rows:
        assert out[name, n] == (slow_ids(text), [name]), (name, n)


def test_sentence_ids_match_brute_force(spark):
    rng = random.Random(8)
    pool = [s for of in licenses.SENTENCES.values() for s in of]
    parts = ["Other words here", "the", "1", ". ", ".", "!", ": ", "; ", "\n", "\n\n", "\n \n", " ", "  ", "é", "::", "...", " . . ", "// ", "\t", "!!", "//"]

    def text() -> str:
        out = ""
        for _ in range(rng.randint(1, 12)):
            s = rng.choice(pool)
            s = rng.choice([s, s.rstrip(".:;"), s.upper(), s.replace(" ", "\n", rng.randint(0, 3)), s[: rng.randint(1, len(s))]])
            out += s + "".join(rng.choices(parts, k=rng.randint(0, 4)))
        return out

    rows = [(i, text()) for i in range(400)]
    out = {r.doc_id: r.sentence_ids for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out == {i: slow_ids(t) for i, t in rows}
    assert sum(map(len, out.values())) > 400


def test_every_sentence_holds_an_anchor():
    known = licenses.known_sentences()
    assert all(any(a in s.split() for a in licenses.anchors(known)) for s in known)
    assert min(map(len, licenses.anchors(known))) > 5


def test_ordered_rules_use_up_identifiers(spark):
    ids = spark.createDataFrame([("aco",), ("axcyo",), ("a",), ("oca",), ("acoa",), ("xdefkt",), ("mm",)], "ids string")
    out = [r.licenses for r in licenses.licence_matches(ids, "ids").collect()]
    assert out == [["apache-2.0-notice"], ["apache-2.0-notice", "cc-by-nc-4.0", "proprietary"], ["apache-2.0"], ["apache-2.0"], ["apache-2.0-notice", "apache-2.0"], ["bsd-3-clause"], ["mit"]]


# Mixing


def slow_share(capacities: list[int], weights: list[float], budget: float) -> list[float]:
    """Shares by repeated redistribution."""
    got, live = [0.0] * len(weights), set(range(len(weights)))
    while live and budget > 1e-9:
        unit = budget / sum(weights[i] for i in live)
        full = {i for i in live if capacities[i] - got[i] <= weights[i] * unit}
        for i in full or live:
            take = capacities[i] - got[i] if full else weights[i] * unit
            got[i] += take
            budget -= take
        live -= full or live
    return got


def test_budgets_go_to_siblings_first(spark):
    leaves = [("w", "en", "a", 1000), ("w", "en", "b", 10), ("w", "de", "c", 500), ("n", "en", "d", 5), ("n", "de", "e", 2000), (None, "en", "f", 300), ("w", None, "g", 40)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    weights = {"domain": {"w": 3, "n": 2}, "lang": {"en": 2}}
    out = {(r.domain, r.lang, r.source): r.share for r in mixing.leaf_budgets(df, 0.5, weights, 2).collect()}
    total = sum(x[3] for x in leaves) // 2
    doms = ["w", "n", None]
    cap = {d: sum(2 * x[3] for x in leaves if x[0] == d) for d in doms}
    share = dict(zip(doms, slow_share([cap[d] for d in doms], [3, 2, 1], total), strict=True))
    for d in doms:
        langs = sorted({x[1] for x in leaves if x[0] == d}, key=str)
        caps = [sum(2 * x[3] for x in leaves if x[:2] == (d, g)) for g in langs]
        by_lang = dict(zip(langs, slow_share(caps, [2 if g == "en" else 1 for g in langs], share[d]), strict=True))
        for g in langs:
            own = [x for x in leaves if x[:2] == (d, g)]
            for x, s in zip(own, slow_share([2 * x[3] for x in own], [1.0] * len(own), by_lang[g]), strict=True):
                assert abs(out[x[:3]] - s) <= 3
    assert out["n", "en", "d"] == 10


def test_mixture_takes_prefixes_of_seeded_epochs(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice(["a", "b"]), rng.choice(["x", None]), rng.choice(["s", "t"]), rng.randint(0, 30)) for i in range(600)] + [(None, "a", "x", "s", 5), (None, "a", "x", "s", 5), (7, "a", "x", "s", None)]
    df = spark.createDataFrame(rows, "doc_id long, domain string, lang string, source string, n_tokens long").withColumn("epoch", F.lit("clash"))
    plan = {(r.domain, r.lang, r.source): r for r in mixing.leaf_budgets(df.groupBy(*mixing.LEVELS).agg(F.sum("n_tokens").alias("tokens")), 1.2, {"domain": {"a": 5}}, 3).collect()}
    out = mixing.mix(df, 1.2, {"domain": {"a": 5}}, 3, 11).collect()
    assert len({r.epoch for r in out}) > 1
    for leaf, p in plan.items():
        mine = [r for r in rows if r[1:4] == leaf]
        whole, rest = divmod(p.share, p.tokens)
        digest = lambda r: int(hashlib.md5(f"11:{whole + 1}:{'null' if r[0] is None else r[0]}".encode()).hexdigest()[:15], 16)  # noqa: E731,B023
        want, run = Counter(), 0
        for e in range(1, whole + 1):
            want.update((r[0], e) for r in mine)
        for r in sorted(mine, key=digest) if rest else []:
            run += r[4] or 0
            if run <= rest:
                want[r[0], whole + 1] += 1
        got = Counter((r.doc_id, r.epoch) for r in out if (r.domain, r.lang, r.source) == leaf)
        assert got == want
    assert mixing.mix(df.limit(0), 0.5).count() == 0
