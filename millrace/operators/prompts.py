"""Prompts and gold answers of question-answering benchmarks; one preparation function a benchmark."""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from . import sampling


def mcq(question: Column, options: Column) -> Column:
    """A question and lettered options."""
    q = F.when(question.endswith("?") | question.endswith("."), question).otherwise(F.concat(question, F.lit("?")))
    listed = F.array_join(F.transform(options, lambda o, i: F.concat(T.letter(i), F.lit(". "), o)), "\n")
    return F.concat(F.lit("Question: "), q, F.lit("\n\nOptions:\n"), listed)


def instructed(df: DataFrame, system: str, user: str, cot: str | None = None) -> DataFrame:
    """The prompt between the two instructions; with ``cot`` the gold answer follows its explanation."""
    out = df.withColumn("prompt", F.concat(F.lit(system + "\n"), "prompt", F.lit("\n" + user + "\n")))
    return out.withColumn("gold", F.concat(F.col(cot), F.lit(".\nThe answer is: "), "gold", F.lit(" ###"))) if cot else out


def demonstration(prompt: Column, gold: Column, cot: bool = False) -> Column:
    if not cot:
        return F.concat(prompt, F.lit("\nThe answer is: "), gold)
    q = F.when(prompt.contains("Question:"), F.split(prompt, "Question:")[1]).otherwise(prompt)
    return F.concat(F.lit("Question: "), q, F.lit("\n"), gold)


def few_shot(df: DataFrame, bank: DataFrame, key: str, shots: int, cot: bool = False, salt: str = "42") -> DataFrame:
    """Each prompt after ``shots`` demonstrations of a seeded shuffle of ``bank``; these are one row, by their number."""
    first = sampling.first_k(bank, key, shots, salt).select(T.uniform(F.col(key), salt).alias("u"), F.col(key).alias("k"), demonstration(F.col("prompt"), F.col("gold"), cot).alias("d"))
    head = first.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("u", "k", "d"))), lambda x: x["d"]), "\n\n").alias("__mr_shots"))
    return df.crossJoin(F.broadcast(head)).withColumn("prompt", F.concat("__mr_shots", F.lit("\n\n"), "prompt")).drop("__mr_shots")


def chat_template(prompt: Column, checkpoint: str, shots: int = 0, system: dict[str, str] | None = None) -> Column:
    """The template that a checkpoint's name asks for; in few-shot prompts the last character goes."""
    system = system or {}
    p = F.substring(prompt, F.lit(1), F.length(prompt) - 1) if shots else prompt
    turn = lambda role, c="": F.concat(F.lit(f"<|im_start|>{role}\n"), c if isinstance(c, Column) else F.lit(c), F.lit("<|im_end|>\n"))
    if "orca" in checkpoint:
        return F.concat(turn(" system", system.get("orca", "You help people find information.")), turn(" question", p), F.lit("<|im_start|> answer\n"))
    if "medical" in checkpoint:
        return F.concat(turn(" system", system.get("medical", "You answer helpfully and truthfully.")), F.lit(" "), turn(" user", p), F.lit(" <|im_start|> assistant\n"))
    if any(x in checkpoint for x in ("medmcqa", "medqa", "pubmedqa")):
        return F.concat(turn("question", p), F.lit("<|im_start|>answer\n"))
    if "med42" in checkpoint:
        q = F.when(p.contains("Question:"), T.strip(F.split(p, "Question:")[1])).otherwise(p)
        return F.concat(F.lit(f"\n<|system|>: {system.get('med42', 'You are a medical assistant.')}\n<|prompter|>:"), q, F.lit("\n<|assistant|>:"))
    return p


def multi_turn(messages: DataFrame, by: str, system: str = "", sep: str = "\n### ", roles: dict[str, str] | None = None) -> DataFrame:
    """(by, prompt): the turns of a conversation under role names, an open answer at the end."""
    roles = roles or {"user": "User", "assistant": "Assistant", "system": "System"}
    name = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in roles.items() for x in kv]), F.col("role")), F.col("role"))
    m = messages.select(by, F.struct("turn", F.concat(name, F.lit(": "), "text").alias("t")).alias("m"))
    turns = F.transform(F.array_sort(F.collect_list("m")), lambda x: x["t"])
    return m.groupBy(by).agg(F.concat(F.lit(system + sep if system else sep.lstrip("\n")), F.array_join(turns, sep), F.lit(sep + roles["assistant"] + ":")).alias("prompt"))


# --- benchmarks


def entities(tokens: Column, tags: Column) -> Column:
    """Entities of B (1), I (2), O (0) tags, joined by #; an I without a B opens one."""
    pair = F.zip_with(tokens, tags, lambda t, g: F.struct(t.alias("t"), g.alias("g")))
    zero = F.struct(F.array().cast("array<string>").alias("done"), F.lit("").alias("open"))

    def fold(a: Column, x: Column) -> Column:
        closed = F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"])
        grown = F.when(a["open"] == "", x["t"]).otherwise(F.concat(a["open"], F.lit(" "), x["t"]))
        return F.struct(F.when(x["g"] == 2, a["done"]).otherwise(closed).alias("done"), F.when(x["g"] == 1, x["t"]).when(x["g"] == 2, grown).otherwise("").alias("open"))

    return F.aggregate(pair, zero, fold, lambda a: F.array_join(F.when(a["open"] != "", F.concat(a["done"], F.array(a["open"]))).otherwise(a["done"]), "#"))


def _medmcqa(df: DataFrame) -> DataFrame:
    gold = F.when(F.col("cop").between(0, 3), T.letter(F.col("cop")))
    return df.withColumns({"prompt": mcq(F.col("question"), F.array("opa", "opb", "opc", "opd")), "gold": gold})


def _pubmedqa(df: DataFrame) -> DataFrame:
    return df.withColumns({"prompt": F.concat(F.array_join("CONTEXTS", "\n"), F.lit("\n"), "QUESTION"), "gold": F.col("final_decision"), "long_answer": F.col("LONG_ANSWER")})


def _pubmedqa_open(df: DataFrame) -> DataFrame:
    return df.withColumns({"prompt": F.col("QUESTION"), "gold": F.col("final_decision")})


def _medqa(df: DataFrame) -> DataFrame:
    """Options as an array of (key, value)."""
    key = F.get(F.filter("options", lambda o: o["value"] == F.col("answer")), F.lit(0))["key"]
    return df.withColumns({"prompt": mcq(F.col("question"), F.transform("options", lambda o: o["value"])), "gold": key})


def _medqa4(df: DataFrame) -> DataFrame:
    """Options as a map, in the order of their letters."""
    pairs = F.array_sort(F.map_entries("options"))
    key = F.get(F.filter(pairs, lambda o: o["value"] == F.col("answer")), F.lit(0))["key"]
    return df.withColumns({"prompt": mcq(F.col("question"), F.transform(pairs, lambda o: o["value"])), "gold": key})


def _medicationqa(df: DataFrame) -> DataFrame:
    return df.withColumns({"prompt": F.col("Question"), "gold": F.col("Answer")})


def _truthfulqa(df: DataFrame) -> DataFrame:
    """The right choice and three draws (with replacement) of the wrong ones, in a seeded order."""
    choices = F.arrays_zip(F.col("mc1_targets.choices").alias("choices"), F.col("mc1_targets.labels").alias("labels"))
    right = F.get(F.filter(choices, lambda c: c["labels"] == 1), F.lit(0))["choices"]
    wrong = F.transform(F.filter(choices, lambda c: c["labels"] != 1), lambda c: c["choices"])
    draw = lambda i: F.element_at(wrong, (F.floor(T.uniform(F.col("question"), f"draw{i}") * F.size(wrong)) + 1).cast("int"))
    mixed = F.array_sort(F.array(*[F.struct(F.md5(F.concat(F.col("question"), F.lit(f"order{i}"))).alias("h"), c.alias("c"), F.lit(i == 0).alias("gold")) for i, c in enumerate([right, draw(1), draw(2), draw(3)])]))
    place = F.array_position(F.transform(mixed, lambda x: x["gold"]), True) - 1
    return df.withColumns({"prompt": mcq(F.col("question"), F.transform(mixed, lambda x: x["c"])), "gold": T.letter(place.cast("int"))})


def _mmlu(df: DataFrame) -> DataFrame:
    return df.withColumns({"prompt": mcq(F.col("input"), F.array("A", "B", "C", "D")), "gold": F.col("target")})


def _gsm8k(df: DataFrame) -> DataFrame:
    parts = F.split("answer", "####")
    return df.withColumns({"prompt": F.col("question"), "gold": T.strip(F.get(parts, F.lit(1))), "steps": T.strip(parts[0])})


def _blurb(df: DataFrame) -> DataFrame:
    ask = F.concat(F.lit("In the sentence below, mark every "), "type", F.lit(" expression; there can be several.\n\nSentence: "), F.array_join("tokens", " "))
    return df.withColumns({"prompt": ask, "gold": entities(F.col("tokens"), F.col("ner_tags"))})


@dataclass(frozen=True)
class Benchmark:
    prepare: Callable[[DataFrame], DataFrame]
    splits: tuple[str, ...] = ("train", "test")
    subsets: tuple[str, ...] = ()
    options: int = 4


MEDICAL_SUBJECTS = tuple(sorted("anatomy clinical_knowledge college_biology college_medicine high_school_biology human_aging human_sexuality medical_genetics nutrition professional_medicine virology".split()))
GENERAL_SUBJECTS = tuple(sorted("astronomy college_chemistry college_physics conceptual_physics global_facts high_school_statistics management philosophy".split()))
BENCHMARKS: dict[str, Benchmark] = {
    "medmcqa": Benchmark(_medmcqa, ("train", "validation")),
    "pubmedqa": Benchmark(_pubmedqa, options=3),
    "pubmedqa_validation": Benchmark(_pubmedqa_open, ("validation",), options=3),
    "medqa": Benchmark(_medqa, options=5),
    "medqa4": Benchmark(_medqa4),
    "medicationqa": Benchmark(_medicationqa, ("train",), options=0),
    "truthfulqa": Benchmark(_truthfulqa, ("validation",)),
    "mmlu_medical": Benchmark(_mmlu, subsets=MEDICAL_SUBJECTS),
    "mmlu_general": Benchmark(_mmlu, subsets=GENERAL_SUBJECTS),
    "gsm8k": Benchmark(_gsm8k, subsets=("main",), options=0),
    "blurb": Benchmark(_blurb, ("train", "validation", "test"), tuple(sorted("ncbi_disease jnlpba bc5disease bc5chem bc2gm".split())), 0),
}

#: system and closing line of each benchmark's instruction; names ending in _cot ask for steps
_ASK = {
    "medqa": "Sit a medical licensing examination: choose one answer from A to E, by current guidelines.",
    "medqa4": "Sit a medical licensing examination: choose one answer from A to D, by current guidelines.",
    "medmcqa": "Sit a medical entrance examination: choose one answer from A to D, by current guidelines.",
    "pubmedqa": "Judge as a clinical scientist whether the statement holds: yes, no or maybe.",
    "medicationqa": "Answer the consumer's question about a medicine fully and plainly.",
    "truthfulqa": "Choose the one truthful answer.",
    "mmlu_medical": "Answer the medical question: choose one of A to D.",
    "mmlu_general": "Answer the question: choose one of A to D.",
    "gsm8k": "Work out the problem and give the number.",
    "blurb": "List the entities, separated by #.",
    "open_question": "Answer the question fully and plainly.",
    "mcq": "Choose the one right answer of the options.",
}
INSTRUCTIONS = {f"{k}{suffix}": (v, end) for k, v in _ASK.items() for suffix, end in (("", "The answer is:"), ("_cot", "Think step by step."))}


def instruction(name: str, cot: bool = False) -> tuple[str, str]:
    """By prompt name; a benchmark without its own instruction has that of the name it begins with."""
    base = max((k for k in _ASK if name.startswith(k)), key=len, default=None)
    if base is None:
        raise KeyError(f"no instruction for {name!r}; there are {sorted(_ASK)}")
    return INSTRUCTIONS[base + ("_cot" if cot else "")]


@dataclass(frozen=True)
class Selection:
    """How a benchmark is run: its kind of task, the split, the name of its prompt, the column of its explanations."""

    task: str
    split: str
    prompt: str
    steps: str | None = None


_OPEN = frozenset(("medicationqa", "blurb"))
_STEPS = {"truthfulqa": "exp", "medmcqa": "exp", "pubmedqa": "long_answer"}
_BORROWED = {"medqa4": "medqa", "mmlu_medical": "medmcqa", "mmlu_general": "medmcqa", "medicationqa": "open_question", "blurb": "open_question"}
_RUN = ("truthfulqa", "medmcqa", "pubmedqa", "medqa", "medqa4", "medicationqa", "mmlu_medical", "mmlu_general", "blurb")
_split_of = lambda n: "validation" if n in ("truthfulqa", "medmcqa") else "test"
#: By table and benchmark. The simple one asks all choices alike, and pubmedqa openly; the one for fine-tuning has its own splits.
SELECTIONS: dict[str, dict[str, Selection]] = {
    "curated": {n: Selection("open" if n in _OPEN else "mcq", _split_of(n), _BORROWED.get(n, n), _STEPS.get(n)) for n in _RUN},
    "simple": {n: Selection("open" if n in _OPEN else "mcq", _split_of(n), "open_question" if n in _OPEN or n == "pubmedqa" else "mcq", _STEPS.get(n)) for n in _RUN},
    "finetune": {n: Selection("open" if n in ("medicationqa", "gsm8k") else "mcq", s, _BORROWED.get(n, n), c) for n, s, c in (("medmcqa", "validation", "exp"), ("pubmedqa", "validation", "LONG_ANSWER"), ("medqa", "test", None), ("medicationqa", "train", None), ("mmlu_medical", "test", None), ("mmlu_general", "test", None), ("gsm8k", "test", "steps"))},
}


def selected(kind: str, benchmark: str, tags: bool = False, cot: bool = False) -> Selection:
    """A table's entry, its prompt name with the endings for tags and steps."""
    if kind not in SELECTIONS or benchmark not in SELECTIONS[kind]:
        raise KeyError(f"no run of {benchmark!r} in {kind!r}; there are {sorted(SELECTIONS.get(kind, SELECTIONS))}")
    s = SELECTIONS[kind][benchmark]
    return replace(s, prompt=s.prompt + "_tags" * tags + "_cot" * cot)


def prepare(df: DataFrame, name: str, shots: int = 0, bank: DataFrame | None = None, key: str = "id", cot: bool = False, with_instruction: bool = True) -> DataFrame:
    """Prompt and gold, then the instruction, then the demonstrations."""
    if name not in BENCHMARKS:
        raise KeyError(f"unknown benchmark {name!r}; there are {sorted(BENCHMARKS)}")
    out = BENCHMARKS[name].prepare(df)
    if with_instruction:
        out = instructed(out, *instruction(name, cot))
    return few_shot(out, bank, key, shots, cot) if shots and bank is not None else out


def with_subset(df: DataFrame, subset: str) -> DataFrame:
    return df.withColumn("subset", F.lit(subset))


# --- generation


def generate(df: DataFrame, model: Callable[[list[str]], list[str]], stop: tuple[str, ...] = ("###",), batch: int = 16, seeds: tuple[int, ...] = (), branches: int = 0) -> DataFrame:
    """``df`` with ``output``: each distinct prompt (and seed, and branch of 1 to ``branches``) is generated once, in batches, and joined
    back. ``model`` goes to the workers; it is called with lists of prompts."""
    rows = df.select("prompt").distinct()
    if seeds:
        rows = rows.crossJoin(df.sparkSession.createDataFrame([(s,) for s in seeds], "seed int"))
    if branches:
        rows = rows.withColumn("branch", F.explode(F.sequence(F.lit(1), F.lit(branches))))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for p in parts:
            out: list[str] = []
            for i in range(0, len(p), batch):
                out += model(p["prompt"].iloc[i : i + batch].tolist())
            yield p.assign(output=[cut_at(o, stop) for o in out])

    made = rows.mapInPandas(run, ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema) + ", output string")
    return df.join(made, "prompt")


def cut_at(s: str, stop: tuple[str, ...]) -> str:
    ends = [s.index(x) for x in stop if x in s]
    return s[: min(ends)] if ends else s


def top_token(logprobs: Column) -> Column:
    """The key of the largest value of a map, of equals the first key."""
    pairs = F.transform(F.map_entries(logprobs), lambda e: F.struct((-e["value"]).alias("v"), e["key"].alias("k")))
    return F.array_min(pairs)["k"]


def iterations(epochs: float, docs: int, batch: int = 64) -> int:
    return 10 * math.ceil(epochs * docs / batch / 10)


def evaluation_iterations(tokens: int, length: int, batch: int) -> int:
    step = length * batch
    return (tokens + step) // step


def parallel_levels(checkpoint: str) -> tuple[int, int]:
    """(tensor, pipeline) from a name that holds -tp2-pp4; 1 where it doesn't."""
    m = re.search(r"-tp(\d+)-pp(\d+)", checkpoint)
    return (int(m[1]), int(m[2])) if m else (1, 1)
