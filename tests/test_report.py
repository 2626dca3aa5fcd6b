"""Reports against one written out, and against a plain writer on random sessions."""

import random

from pyspark.sql import functions as F

from tests.test_sources import events
from weft.functions.text import session_hash
from weft.operators import report

INDEX = "path string, source string, model string, worked_ms long, total long, output long, cache_read long, chapters long, errors long, tool_counts map<string,long>"


def test_a_report(spark):
    ls = [("a", "Bash", '{"command":"ls -l\\nmore"}')]
    rows = [("user", "\n".join(f"line {i}" for i in range(12))), ("assistant", "", ls), ("tool_result", "one\ntwo\nthree\nfour\nfive", None, "a"), ("assistant", "", [("b", "Bash", '{"command":"make"}'), ("c", "Read", '{"file_path":"/x/y/z.py"}'), ("d", "Read", '{"file_path":"/x/y/z.py"}'), ("e", "Edit", '{"file_path":"/x/y/z.py"}')]), ("tool_result", "no rule\nto make", None, "b", True), ("tool_result", "gone wrong", None, None, True), ("assistant", "done"), ("user", "next")]
    index = spark.createDataFrame([("p", "claude", "m", 65_000, 1500, 300, 0, 2, 2, {"Bash": 2, "Read": 2, "Edit": 1}), ("q", None, None, 0, 0, 0, 0, 0, 0, {})], INDEX)
    got = {r["path"]: r["markdown"] for r in report.session_reports(events(spark, rows), index).collect()}
    hashes = {r["path"]: r["h"] for r in index.select("path", session_hash(F.col("path")).alias("h")).collect()}
    assert got["q"] == f"# Session {hashes['q']}\n\n\n\n## Summary\n\n- **Prompts:** 0\n- **Turns:** 0\n- **Tool calls:** 0\n\n---\n\n"
    quoted = "\n".join(f"> line {i}" for i in range(10))
    head, _, rest = got["p"].partition("\n\n---\n\n")
    assert head.startswith(f"# Session {hashes['p']}\n\n**Model:** m  \n**Source:** claude  \n**Duration:** ") and "**Estimated cost:** $" in head
    assert head.endswith("- **Prompts:** 2\n- **Turns:** 3\n- **Tool calls:** 5\n- **Tokens:** 1.5K (1.2K in, 300 out)\n- **Errors:** 2\n- **Tools:** Bash (2), Read (2), Edit (1)")
    assert rest == f"""## Chapter 1

{quoted}
> ...

*3 turns*

### Files

- `y/z.py` — read x2, edit

### Commands

**[ok]** `ls -l more`

```
one
two
three
four
```

**[FAIL]** `make`

```
no rule
to make
```

### Errors

- `make`
  > no rule
- **session:** gone wrong

### Response

done

---

## Chapter 2

> next

---
"""


def test_many_commands(spark):
    rng = random.Random(0)
    rows = [("user", "go")]
    bad = []
    for i in range(30):
        bad.append(rng.random() < 0.5)
        rows += [("assistant", "", [(f"i{i}", "Bash", f'{{"command":"c{i}"}}')]), ("tool_result", "", None, f"i{i}", bad[-1])]
    text = report.chapter_sections(events(spark, rows)).collect()[0]["markdown"]
    assert "*...and 18 more commands*" in text and text.count("**[") == 12
    assert [f"c{i}" for i, b in enumerate(bad) if b][:5] == [x.split("`")[1] for x in text.partition("### Errors")[2].split("\n") if x.startswith("- `")]
