"""Chat templates as text: each turn's prompt and answer, and whole conversations. Own templates can be registered."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """Texts with {content} (tool: an observation), what comes first, the default system text, and whether the system text joins the first user turn."""

    user: str
    assistant: str
    system: str = "{content}"
    tool: str | None = None
    start: str = ""
    default_system: str = ""
    system_in_user: bool = False


# Formats that models were trained on.
TEMPLATES: dict[str, Template] = {
    "alpaca": Template(
        "### Instruction:\n{content}\n\n### Response:\n", "{content}\n\n", "{content}\n\n",
        default_system="Below is an instruction that describes a task. Write a response that appropriately completes the request.",
    ),
    "baichuan2": Template("<reserved_106>{content}<reserved_107>", "{content}"),
    "chatml": Template(
        "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n", "{content}<|im_end|>\n", "<|im_start|>system\n{content}<|im_end|>\n",
        "<|im_start|>tool\n{content}<|im_end|>\n<|im_start|>assistant\n",
    ),
    "deepseek": Template("User: {content}\n\nAssistant:", "{content}<｜end▁of▁sentence｜>", "{content}\n\n", start="<｜begin▁of▁sentence｜>"),
    "gemma": Template(
        "<start_of_turn>user\n{content}<end_of_turn>\n<start_of_turn>model\n", "{content}<end_of_turn>\n", "{content}\n\n",
        "<start_of_turn>tool\n{content}<end_of_turn>\n<start_of_turn>model\n", "<bos>", system_in_user=True,
    ),
    "glm4": Template("<|user|>\n{content}<|assistant|>", "\n{content}", "<|system|>\n{content}", "<|observation|>\n{content}<|assistant|>", "[gMASK]<sop>"),
    "llama2": Template("<s>[INST] {content} [/INST]", " {content} </s>", "<<SYS>>\n{content}\n<</SYS>>\n\n", system_in_user=True),
    "llama3": Template(
        "<|start_header_id|>user<|end_header_id|>\n\n{content}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "{content}<|eot_id|>",
        "<|start_header_id|>system<|end_header_id|>\n\n{content}<|eot_id|>",
        "<|start_header_id|>ipython<|end_header_id|>\n\n{content}<|eot_id|><|start_header_id|>assistant<|end_header_id|>\n\n", "<|begin_of_text|>",
    ),
    "mistral": Template("[INST] {content}[/INST]", " {content}</s>", "{content}\n\n", '[TOOL_RESULTS] {"content": {content}}[/TOOL_RESULTS]', "<s>", system_in_user=True),
    "phi3": Template("<|user|>\n{content}<|end|>\n<|assistant|>\n", "{content}<|end|>\n", "<|system|>\n{content}<|end|>\n"),
    "qwen": Template(
        "<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n", "{content}<|im_end|>\n", "<|im_start|>system\n{content}<|im_end|>\n",
        "<|im_start|>user\n<tool_response>\n{content}\n</tool_response><|im_end|>\n<|im_start|>assistant\n",
        default_system="You are Qwen, created by Alibaba Cloud. You are a helpful assistant.",
    ),
    "vicuna": Template(
        "USER: {content} ASSISTANT:", "{content}</s>", "{content} ",
        default_system="A chat between a curious user and an artificial intelligence assistant. The assistant gives helpful, detailed, and polite answers to the user's questions.",
    ),
    "yi": Template("<|im_start|>user\n{content}<|im_end|>\n<|im_start|>assistant\n", "{content}<|im_end|>\n", "<|im_start|>system\n{content}<|im_end|>\n"),
    "zephyr": Template("<|user|>\n{content}</s><|assistant|>\n", "{content}</s>", "<|system|>\n{content}</s>", default_system="You are Zephyr, a helpful assistant."),
}


def register(name: str, template: Template) -> None:
    """A template under a new name; one that is there stays."""
    if name in TEMPLATES:
        raise ValueError(f"the template {name} exists")
    TEMPLATES[name] = template


def _put(form: str, content: Column) -> Column:
    before, after = form.split("{content}")
    return F.concat(F.lit(before), F.coalesce(content, F.lit("")), F.lit(after))


def turns(messages: Column, system: Column, name: str) -> Column:
    """Array of struct(source, target): the text before each answer, and the answer, of messages (role, content) in pairs; an odd last one has no target.

    An observation (role tool, observation) counts as a user turn in its own form; the start and the system text lead the first source.
    """
    t = TEMPLATES[name]
    said = F.when(F.coalesce(system, F.lit("")) != "", system).otherwise(t.default_system)
    lead = F.when(said != "", _put(t.system, said)).otherwise("")
    asked = F.filter(messages, lambda m, i: i % 2 == 0)
    answered = F.filter(messages, lambda m, i: i % 2 == 1)

    def one(m: Column, i: Column) -> Column:
        first = i == 0
        text = F.when(first, F.concat(lead, F.coalesce(m["content"], F.lit("")))).otherwise(F.coalesce(m["content"], F.lit(""))) if t.system_in_user else m["content"]
        form = F.when(m["role"].isin("tool", "observation"), _put(t.tool, m["content"])).otherwise(_put(t.user, text)) if t.tool else _put(t.user, text)
        before = F.when(first, F.lit(t.start) if t.system_in_user else F.concat(F.lit(t.start), lead)).otherwise("")
        answer = F.get(answered, i)
        return F.struct(F.concat(before, form).alias("source"), F.when(answer.isNotNull(), _put(t.assistant, answer["content"])).alias("target"))

    return F.transform(asked, one)


def one_turn(messages: Column, system: Column, name: str) -> Column:
    """struct(source, target): everything before the last answer, and the last answer."""
    pairs = turns(messages, system, name)
    n = F.size(pairs)
    before = F.flatten(F.transform(F.slice(pairs, 1, F.greatest(n - 1, F.lit(0))), lambda p: F.array(p["source"], F.coalesce(p["target"], F.lit("")))))
    last = F.element_at(pairs, -1)
    return F.when(n > 0, F.struct(F.concat(F.array_join(before, ""), last["source"]).alias("source"), last["target"].alias("target")))


def whole(messages: Column, system: Column, name: str) -> Column:
    """The conversation as one text."""
    return F.array_join(F.flatten(F.transform(turns(messages, system, name), lambda p: F.array(p["source"], F.coalesce(p["target"], F.lit(""))))), "")
