"""Answer checks: native expressions on the response text."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# What is trimmed off a token before its length is compared, and what is trimmed
# off a classification answer, in this order.
TOKEN_EDGE = ",\n:;!?'"
ANSWER_EDGES = ("<b>", "\n", "</b>")
SHORT_ANSWER = 3
INTEGER_PATTERN = r"^\s*[+-]?\d+(_\d+)*\s*$"


def strip_space(text: Column) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def crop_echo(output: Column, prompt: Column, echoes: Column, parity: bool = False) -> Column:
    """Drop the prompt a model repeats before its answer.

    The prompt is cut only where the output really starts with it, with or without its last
    blank. ``parity=True`` cuts by length whatever the output starts with.
    """
    if parity:
        cut = F.substr(output, F.length(prompt) + 1)
    else:
        bare = F.rtrim(prompt)

        def behind(echo: Column) -> Column:  # by bytes: the characters of an echo need not be counted to skip it
            return F.substr(output.cast("binary"), F.octet_length(echo) + 1).cast("string")

        cut = (
            F.when(F.startswith(output, prompt), behind(prompt))
            .when(F.startswith(output, bare), behind(bare))
            .otherwise(output)
        )
    return F.when(echoes, cut).otherwise(output)


def first_line(text: Column) -> Column:
    return F.substring_index(text, "\n", 1)


def after_marker(text: Column, marker: str) -> Column:
    """Text between the first and the second marker; empty where there is no marker."""
    start = F.instr(text, F.lit(marker))
    rest = F.substr(text, start + len(marker))
    return F.when(start > 0, F.substring_index(rest, marker, 1)).otherwise(F.lit(""))


def completion_line(text: Column) -> Column:
    """First line, or the second where the first has fewer than five words (none -> empty)."""
    lines = F.split(text, "\n")
    few = F.size(F.split(F.get(lines, F.lit(0)), " ")) < 5
    return F.coalesce(F.when(few, F.get(lines, F.lit(1))).otherwise(F.get(lines, F.lit(0))), F.lit(""))


def clean_answer(output: Column) -> Column:
    """White space, then each set of edge characters in turn."""
    text = strip_space(output)
    for edge in ANSWER_EDGES:
        text = F.btrim(text, F.lit(edge))
    return text


def short_answer(answer: Column, rule: Column | str) -> Column:
    """First three characters, except where the answer is a class name."""
    rule = rule if isinstance(rule, Column) else F.lit(rule)
    return F.when(rule == "class_name", answer).otherwise(F.left(answer, F.lit(SHORT_ANSWER)))


def classification_answer(target: Column, rule: str, positive: str | None = None,
                          threshold: float | None = None) -> Column:
    """Answer text a target stands for: Yes / No, the class name, or the class digit."""
    if rule == "yes_no":
        yes = target.cast("double") >= threshold if threshold is not None else target == positive
        return F.when(yes, F.lit("Yes")).otherwise(F.lit("No"))
    if rule == "class_name":
        return target
    if rule == "class_digit":
        return F.substr(target, F.lit(len("class_") + 1))
    raise ValueError(f"unknown classification rule: {rule}")


def classification_label(target: Column, rule: str, positive: str | None = None,
                         negative: str | None = None, threshold: float | None = None) -> Column:
    """What a response is judged against; null where the target is neither label."""
    if rule == "yes_no":
        if threshold is not None:
            number = target.cast("double")
            return F.when(number >= threshold, F.lit("Yes")).when(number < threshold, F.lit("No"))
        return F.when(target == positive, F.lit("Yes")).when(target == negative, F.lit("No"))
    if rule in ("class_name", "class_digit"):
        return target
    raise ValueError(f"unknown classification rule: {rule}")


def classification_passed(answer: Column, label: Column, rule: Column) -> Column:
    """Is a cleaned answer right? An empty answer and an unknown label never are."""
    low = F.lower(short_answer(answer, rule))
    says_yes = F.contains(low, F.lit("yes")) | F.contains(low, F.lit("1"))
    says_no = F.contains(low, F.lit("no")) | F.contains(low, F.lit("0"))
    right = (
        F.when(rule == "yes_no", ((label == "Yes") & says_yes) | ((label == "No") & says_no))
        .when(rule == "class_name", F.contains(low, F.lower(label)))
        .when(rule == "class_digit", F.contains(F.concat(F.lit("class_"), low), label))
    )
    return F.coalesce(right & (answer != ""), F.lit(False))


def membership_passed(answer: Column, label: Column) -> Column:
    """The expected word is said and the other one is not (case-sensitive)."""
    yes, no = F.contains(answer, F.lit("Yes")), F.contains(answer, F.lit("No"))
    return F.when(label == "Yes", yes & ~no).otherwise(no & ~yes)


def needle(word: Column) -> Column:
    """The part of a word before ``(``, trimmed; the whole word where nothing is left."""
    cut = strip_space(F.substring_index(word, "(", 1))
    return F.when(F.contains(word, F.lit("(")) & (cut != ""), cut).otherwise(word)


def haystacks(output: Column, case_sensitive: Column | bool = False) -> Column:
    """The response as it is searched: plain, with ``_`` read as ``.``, with ``_`` as blank."""
    if isinstance(case_sensitive, bool):
        text = output if case_sensitive else F.lower(output)
    else:
        text = F.when(case_sensitive, output).otherwise(F.lower(output))
    return F.array(text, F.replace(text, F.lit("_"), F.lit(".")), F.replace(text, F.lit("_"), F.lit(" ")))


def word_found(stacks: Column, word: Column, case_sensitive: Column | bool = False) -> Column:
    """Does a word appear, allowing an underscore for a dot or a blank?

    ``stacks`` is ``haystacks(output)``, computed once per response.
    """
    if isinstance(case_sensitive, bool):
        w = word if case_sensitive else F.lower(word)
    else:
        w = F.when(case_sensitive, word).otherwise(F.lower(word))
    stack = (
        F.when(F.contains(w, F.lit(".")), F.get(stacks, F.lit(1)))
        .when(F.contains(w, F.lit(" ")), F.get(stacks, F.lit(2)))
        .otherwise(F.get(stacks, F.lit(0)))
    )
    spaced = F.contains(w, F.lit("_")) & F.contains(stack, F.replace(w, F.lit("_"), F.lit(" ")))
    return F.contains(stack, w) | spaced


def words_considered(words: Column) -> Column:
    """Words that decide: those outside the lexicon where there are any, else all."""
    def outside(w: Column) -> Column:
        return (w["kind"] == "string") & ~w["in_lexicon"]

    return F.when(F.exists(words, outside), F.filter(words, outside)).otherwise(words)


def word_matches(considered: Column, stacks: Column, case_sensitive: Column | bool = False) -> Column:
    """(name, found) for each listed word; values that are not text are not listed."""
    listed = F.filter(considered, lambda w: w["kind"] != "other")
    return F.transform(
        listed,
        lambda w: F.struct(
            needle(w["value"]).alias("name"),
            word_found(stacks, needle(w["value"]), case_sensitive).alias("found"),
        ),
    )


def whole_integer(output: Column) -> Column:
    """Canonical text of an output that is one integer, else null."""
    digits = F.regexp_replace(output, r"[\s_]", "")
    return F.when(is_whole_integer(output), digits.try_cast("decimal(38,0)").cast("string"))


def is_whole_integer(output: Column) -> Column:
    return output.rlike(INTEGER_PATTERN)


def value_matched(output: Column, tokens: Column, is_integer: Column, integer: Column,
                  text: Column, as_integer: Column) -> Column:
    """Strict match of one expected value.

    An output that is an integer is compared as a number only. Otherwise a value with a blank
    must be contained, and any other value must be a token once the token's edges are trimmed.
    """
    is_token = F.exists(
        tokens,
        lambda w: F.contains(w, text) & (F.length(trim_token(w)) == F.length(text)),
    )
    matched = F.when(is_integer, F.coalesce(integer == as_integer, F.lit(False))).otherwise(
        F.when(F.contains(text, F.lit(" ")), F.contains(output, text)).otherwise(is_token)
    )
    return F.coalesce(matched, F.lit(False))


def trim_token(token: Column) -> Column:
    return F.btrim(token, F.lit(TOKEN_EDGE))
