"""Prompts for the teacher and for evaluation, and the token budget."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import first_tokens, has_description, line_numbers, lines, numbered, present, strip, token_count, tokens

# Context size, tokens kept free for the answer, and the least worth of a cut message.
CAPACITY, RESERVED, LEAST_MESSAGE = 32768, 4096, 40
# The prompts' sentences.
OPENING = "You are a security expert analyzing code for vulnerabilities."
ANALYZE = "Analyze the following code snippet:"
VULNERABLE_HINT = "Hint: This code contains a security vulnerability."
VULNERABLE_LINES = "The changed lines that might be related to the vulnerability are: "
PATCHED_HINT = "Hint: This code is the patched (non-vulnerable) version."
PATCHED_LINES = "The lines where the fix was applied are: "
YES_NO_TASK = (
    "Please indicate your analysis result *only* with one of the following exact statements, without any additional explanatory text: "
    "'(1) YES: A security vulnerability detected.' or '(2) NO: No security vulnerability.'."
)
YES_NO_HEAD = "Please analyze the following code:\n```\n"
YES_NO_TAIL = (
    "\n```\nPlease indicate your analysis result with one of the options: \n(1) YES: A security vulnerability detected.\n"
    "(2) NO: No security vulnerability. \n\nOnly reply with one of the options above. Do not include any further information."
)
TASK = (
    "Task: After your reasoning, provide your analysis in JSON format: "
    '{"classification": "VULNERABLE" or "NOT_VULNERABLE", "important_lines": [...], "reasoning_summary": "..."}'
)


def joined(items: Column) -> Column:
    """Items with a comma between, or null if there are none."""
    return F.when(F.size(items) > 0, F.array_join(items.cast("array<string>"), ", "))


def context(cve: Column, cwe: Column, description: Column, message: Column) -> Column:
    """Bullets for what is known, or null if nothing is."""
    filled = lambda items: joined(F.filter(items, lambda x: x.isNotNull() & (x != "")))
    parts = [
        F.concat(F.lit("CVE: "), filled(cve)),
        F.concat(F.lit("CWE: "), filled(cwe)),
        F.when(has_description(description), F.concat(F.lit("Description: "), description)),
        F.concat(F.lit("Commit message: "), F.nullif(message, F.lit(""))),
    ]
    some = F.array_compact(F.array(*parts))
    return F.when(F.size(some) > 0, F.concat(F.lit("Context:\n- "), F.array_join(some, "\n- ")))


def training_prompt(code: Column, is_vulnerable: Column | None = None, known: Column | None = None, truth: Column | None = None, added: Column | None = None) -> Column:
    """The prompt with hints if `is_vulnerable` is given (known: context text or null), else without."""
    parts = [F.lit(f"{OPENING}\n\n{ANALYZE}\n\n```"), numbered(code), F.lit("```\n")]
    if is_vulnerable is not None:
        parts.append(F.concat(known, F.lit("\n")))
        hint = F.when(is_vulnerable, F.concat_ws("\n", F.lit(VULNERABLE_HINT), F.concat(F.lit(VULNERABLE_LINES), joined(truth), F.lit("."))))
        parts.append(hint.when(~is_vulnerable, F.concat_ws("\n", F.lit(PATCHED_HINT), F.concat(F.lit(PATCHED_LINES), joined(added), F.lit(".")))))
        parts.append(F.lit(""))
    return F.concat_ws("\n", *parts, F.lit(TASK))


def yes_no_prompt(code: Column) -> Column:
    return F.concat(F.lit(YES_NO_HEAD), code, F.lit(YES_NO_TAIL))


def first_generation_prompt(code: Column, description: Column, is_vulnerable: Column, changed: Column, number_above: int = 20) -> Column:
    """The prompt of the first generation of data, with real line breaks: lines are numbered in longer code only."""
    text = F.when(F.size(lines(code)) > number_above, numbered(code)).otherwise(code)
    known = F.when(has_description(description), F.concat(F.lit("The associated CVE description is: "), strip(description), F.lit("\n\n")))
    label = F.when(is_vulnerable, "vulnerable").otherwise("not vulnerable")
    more = F.when(is_vulnerable, F.concat(F.lit(VULNERABLE_LINES), F.nullif(changed, F.lit("")), F.lit(".\n"))).otherwise("This code snippet is the non-vulnerable version.\n")
    return F.concat(
        F.lit("Please analyze the following code snippet:\n\n```\n"), text, F.lit("\n```\n\n"), F.coalesce(known, F.lit("")),
        F.lit("Hint: According to the ground truth, this code snippet is considered "), label, F.lit(".\n"), F.coalesce(more, F.lit("")), F.lit("\nTask: " + YES_NO_TASK),
    )


def requests(pairs, drop_message_with_description: bool = True, longest_answer: int = CAPACITY):
    """Two rows for each pair, vulnerable and patched, with prompt, prompt_tokens and api_max_tokens; what can't fit is dropped.

    The commit message goes in whole if it fits; a description makes up for it; else it is cut if enough room is left.
    A message stands between blanks in a prompt, so its tokens and those of its label are added to those of the prompt
    without it: each message is split once, and each prompt is made once.
    """
    both = F.array(F.struct(F.lit(True).alias("is_vulnerable"), F.col("vuln_func").alias("code")), F.struct(F.lit(False).alias("is_vulnerable"), F.col("patched_func").alias("code")))
    rows = pairs.select("*", F.inline(both))
    rows = rows.withColumn("ground_truth_lines", F.when(F.col("is_vulnerable"), line_numbers(F.col("deleted_lines"))).otherwise(F.array().cast("array<int>")))
    described, none = has_description(F.col("cve_desc")), F.lit(None).cast("string")

    def known(words: Column) -> Column:
        return context(F.col("cve"), F.col("cwe"), F.col("cve_desc"), words)

    def prompt(words: Column) -> Column:
        return training_prompt(F.col("code"), F.col("is_vulnerable"), known(words), F.col("ground_truth_lines"), line_numbers(F.col("added_lines")))

    room = CAPACITY - RESERVED
    rows = rows.withColumn("_base_tokens", F.size(tokens(prompt(none)))).filter(F.col("_base_tokens") <= room)
    left, words = F.lit(room) - F.col("_base_tokens"), F.col("_words")
    rows = rows.withColumn("_message", present(F.col("commit_message")))
    plain = F.col("_message").isNull() | (F.lit(drop_message_with_description) & described)
    rows = rows.withColumn("_words", F.when(~plain, tokens(F.col("_message"))))
    label = F.when(known(none).isNull(), 4).otherwise(3)  # "Context:" if nothing else is known, "-", "Commit" and "message:"
    rows = rows.withColumn("_label_tokens", F.when(words.isNotNull(), label))
    fits = F.col("_base_tokens") + F.col("_label_tokens") + F.size(words) <= room
    chosen = F.when(words.isNull(), none).when(fits, F.col("_message")).when(described | (left < LEAST_MESSAGE), none).when(F.size(words) <= left, F.col("_message")).otherwise(first_tokens(words, left))
    rows = rows.withColumn("_chosen", chosen).withColumn("prompt", prompt(F.col("_chosen")))
    more = F.when(F.col("_chosen").isNull(), 0).otherwise(F.col("_label_tokens") + F.least(F.size(words), left))
    rows = rows.withColumn("prompt_tokens", F.col("_base_tokens") + more)
    rows = rows.withColumn("api_max_tokens", F.least(F.lit(longest_answer), F.lit(CAPACITY) - F.col("prompt_tokens")))
    return rows.drop("_base_tokens", "_message", "_words", "_label_tokens", "_chosen")


def eval_requests(pairs, prompt_types: tuple[str, ...] = ("training", "std_cls")):
    """A row for each pair, label and prompt type; a prompt that can't fit has a SKIPPED response, others none yet."""
    both = F.array(F.struct(F.lit(True).alias("is_vulnerable"), F.col("vuln_func").alias("code")), F.struct(F.lit(False).alias("is_vulnerable"), F.col("patched_func").alias("code")))
    rows = pairs.select("*", F.inline(both)).withColumn("prompt_type", F.explode(F.array(*map(F.lit, prompt_types))))
    rows = rows.withColumn("prompt", F.when(F.col("prompt_type") == "std_cls", yes_no_prompt(F.col("code"))).otherwise(training_prompt(F.col("code"))))
    count = token_count(F.col("prompt"))
    skipped = F.concat(F.lit("SKIPPED: prompt_too_long:"), count.cast("string"), F.lit("_tokens"))
    return rows.withColumn("target", F.col("is_vulnerable").cast("int")).withColumn("response", F.when(count > CAPACITY - RESERVED, skipped))
