"""Prompts, and answers of a model as checked columns. The model is a function that the caller gives."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

TRIES = 3
#: What an answer must hold, by task.
SCHEMAS = {"label": "sense int, rating int", "menu": "sense string, rating int, synonyms array<string>", "senses": "senses array<struct<definition:string, pos:string>>", "covered": "all_covered boolean", "critic": "ok boolean, reason string", "pos": "pos string"}
#: A model: from a batch of prompts to an answer for each.
Model = Callable[[list[str]], list[str]]


def label_prompt(form: Column, menu: Column, context: Column) -> Column:
    """Asks for the sense of a marked form among those of a menu, how well it fits, and words that would fit as well."""
    rules = (
        "\nRate the fit: 2 if the sense fits well, 1 if a closer one could exist, 0 if none of them is meant; between 0 and 1 take 0."
        '\nWith rating 0 the sense is "0" for noise, a name or a use that will not come again, and "_none" for a real meaning that the senses lack.'
        "\nList synonyms that could stand in its place, roughly; none if there are none."
        '\nAnswer as JSON: {"sense": "1", "rating": 2, "synonyms": ["word"]}'
    )
    return F.concat(F.lit("Which sense does the marked word have?\nWord: "), form, F.lit("\nText: "), context, F.lit("\nSenses:\n"), menu, F.lit(rules))


def sense_prompt(form: Column, contexts: Column, known: Column) -> Column:
    """Asks for senses of a form that the contexts show and the known ones do not cover."""
    return F.concat(F.lit("Define the senses of the word that the known ones leave out.\nWord: "), form, F.lit("\nKnown:\n"), F.array_join(known, "\n"), F.lit("\nTexts:\n"), F.array_join(contexts, "\n"), F.lit('\nAnswer as JSON: {"senses": [{"definition": text, "pos": text}]}'))


def pos_prompt(form: Column, definition: Column, contexts: Column, known: tuple[str, ...]) -> Column:
    """Asks for the part of speech of a sense, one of those known."""
    return F.concat(F.lit(f"Which part of speech is it: {', '.join(known)}?\nWord: "), form, F.lit("\nSense: "), definition, F.lit("\nTexts:\n"), F.array_join(contexts, "\n"), F.lit('\nAnswer as JSON: {"pos": text}'))


def critic_prompt(form: Column, definition: Column, question: Column) -> Column:
    """Asks a yes or no question on a sense."""
    return F.concat(question, F.lit("\nWord: "), form, F.lit("\nSense: "), definition, F.lit('\nAnswer as JSON: {"ok": true or false, "reason": text}'))


def found_json(answer: str, expected: tuple[str, ...] = ()) -> str | None:
    """The JSON object of an answer: what a fence holds, or all of it, or one that stands in it.

    Of several in the text it is the last one with an expected key, as models think aloud before
    they answer; where none has one, the first.
    """
    fence = re.search(r"```(?:json)?\s*(.*?)```", answer, re.S)
    for part in (fence[1] if fence else "", answer):
        try:
            if isinstance(json.loads(part), dict):
                return part.strip()
        except ValueError:
            pass
    found, at = [], answer.find("{")
    while at >= 0:
        try:
            value, end = json.JSONDecoder().raw_decode(answer, at)
            found.append((value, answer[at:end]))
            at = answer.find("{", end)
        except ValueError:
            at = answer.find("{", at + 1)
    fit = [text for value, text in found if any(k in value for k in expected)]
    return fit[-1] if fit else found[0][1] if found else None


def ask(rows: DataFrame, ask_model: Model, schema: str, prompt: str = "prompt", tries: int = TRIES) -> DataFrame:
    """rows with the answer to their prompt, as a struct of the schema; null where no try gave one.

    ask_model takes a batch of prompts in a task; those without readable JSON are asked again, up
    to tries times. A null prompt is not asked. Repeated rows are asked each.
    """
    names = rows.columns
    keys = tuple(f.name for f in StructType.fromDDL(schema).fields)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            answers: dict[int, str | None] = {}
            open_ = [i for i, p in enumerate(b[prompt]) if isinstance(p, str)]
            for _ in range(tries):
                if not open_:
                    break
                for i, a in zip(open_, ask_model([b[prompt].iloc[i] for i in open_]), strict=True):
                    answers[i] = found_json(a, keys) if a else None
                open_ = [i for i in open_ if answers[i] is None]
            yield b.assign(_answer=[answers.get(i) for i in range(len(b))])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInPandas(run, f"{kinds}, _answer string").select(*names, F.from_json("_answer", schema).alias("answer"))
