"""Packages for assistants: targets, manifest, prompts, and the copy to disk."""

from __future__ import annotations

import re
import shutil
import tempfile
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leafmark.functions import text as T


@dataclass(frozen=True)
class Target:
    id: str
    display_name: str
    folder_prefix: str
    files_subdir: str
    prompt_template: str


_ASK = """# {title}

The files of this package are in `{{package_root}}/{subdir}/`:

{{files_abs_list}}

- Name: {{name}}
- What it is about: {{description}}

## What to do

{steps}
"""


def _template(title: str, subdir: str, *steps: str) -> str:
    return _ASK.format(title=title, subdir=subdir, steps="\n".join(f"{n}. {step}" for n, step in enumerate(steps, 1)))


TARGETS = {
    t.id: t
    for t in (
        Target("claude-skill", "Claude skill", "skill-", "references", _template(
            "Make a skill of these references", "references",
            "Read every file listed above and note what each of them can answer.",
            "Write `{package_root}/SKILL.md`. It begins with a YAML header that holds `name` ({name}), `description`, and `allowed-tools` where the skill needs any.",
            "Say in its first paragraph when the skill applies, with words that a user would really write.",
            "List the references, one line each, with the questions that a reader should open them for.",
            "Change nothing in `references/`: it is what the skill knows. The folder can then be moved to where skills are installed.",
        )),
        Target("chatgpt-gpt", "Custom GPT", "gpt-", "knowledge", _template(
            "Make a custom GPT of this knowledge", "knowledge",
            "Open the editor for custom GPTs and give it the name and the description above.",
            "Write its instructions in three or four paragraphs: it answers from the knowledge files first, says which passage an answer rests on, and admits what they don't cover.",
            "Propose three conversation starters that a user of this material would type.",
            "Upload all files of `knowledge/`. Leave web search and pictures off unless the material calls for them.",
            'Check the settings as JSON before saving: {{"name": "{name}", "description": "...", "instructions": "..."}}.',
        )),
        Target("cursor-rules", "Cursor rules", "cursor-", "docs", _template(
            "Make an editor rule of these docs", "docs",
            "In the project that the rule is for, create `.cursor/rules/{name}.md`.",
            'Begin it with a YAML header: `description` as above, `globs` (start with `["**/*"]` and narrow it to the files that the docs speak of), `alwaysApply: false`.',
            "Say in a few sentences what the rule covers and when it should be shown.",
            "For each doc, give its path and one line on what a programmer finds there.",
            "The docs may stay where they are, or be copied into the project; keep the paths of the rule right.",
        )),
        Target("gemini-cli", "Gemini CLI extension", "gemini-", "references", _template(
            "Make a command-line extension of these references", "references",
            "Write `{package_root}/GEMINI.md`: which field of knowledge this is, which requests should bring it up, and for each reference a line on what is in it.",
            'To install it as an extension, add `{package_root}/gemini-extension.json`: {{"name": "{name}", "version": "0.1.0", "contextFileName": ["GEMINI.md"]}}.',
            "Either start the command line in this folder, or move the folder to where extensions are installed.",
        )),
    )
}


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(t.id, t.display_name, t.folder_prefix, t.files_subdir, t.prompt_template) for t in TARGETS.values()], "target string, display_name string, folder_prefix string, files_subdir string, prompt_template string")


def manifest(files: DataFrame, name: Column, out_root: str = ".") -> DataFrame:
    """(target, package, file, path) of files (file): where each file goes in each target's package. The four targets are broadcast."""
    t = F.broadcast(targets(files.sparkSession))
    package = F.concat("folder_prefix", T.package_slug(name))
    df = files.join(t).withColumn("package", package)
    return df.select("target", "package", "file", F.concat_ws("/", F.lit(out_root), "package", "files_subdir", "file").alias("path"))


def prompts(entries: DataFrame, name: str, description: str, out_root: str = ".") -> DataFrame:
    """(target, package, prompt): templates filled from a manifest."""
    df = entries.groupBy("target", "package").agg(F.array_sort(F.collect_list("path")).alias("paths")).join(F.broadcast(targets(entries.sparkSession).select("target", "prompt_template")), "target")
    out = F.col("prompt_template")
    values = {"name": F.lit(name), "description": F.lit(description), "package_root": F.concat_ws("/", F.lit(out_root), "package"), "files_abs_list": F.array_join(F.transform("paths", lambda p: F.concat(F.lit("- `"), p, F.lit("`"))), "\n")}
    for key, value in values.items():
        out = F.replace(out, F.lit("{" + key + "}"), value)
    return df.select("target", "package", F.replace(F.replace(out, F.lit("{{"), F.lit("{")), F.lit("}}"), F.lit("}")).alias("prompt"))


def slug_of(name: str) -> str:
    """package_slug for one name on the driver."""
    words = re.split(r"[\s_-]+", re.sub(r"[^\w\s-]", "", name.lower()))
    return "-".join(filter(None, words)) or "skill"


def build_package(target_id: str, name: str, description: str, source_files: list[Path], output_root: Path) -> Path:
    """Copies files flat to <prefix><slug>/<subdir> and writes PROMPT.md. Nothing is touched unless all sources are files. The package is made
    beside the old one and takes its place when it is whole; of files of one name the last stays, the list shows all."""
    target = TARGETS[target_id]
    sources = [Path(f) for f in source_files]
    missing = [str(f) for f in sources if not f.is_file()]
    if missing or not sources:
        raise FileNotFoundError(", ".join(missing)) if missing else ValueError("no files to package")
    root = Path(output_root).resolve() / (target.folder_prefix + slug_of(name))
    root.parent.mkdir(parents=True, exist_ok=True)
    with tempfile.TemporaryDirectory(dir=root.parent, prefix=".package-") as made:
        new = Path(made) / root.name
        paths = [Path(target.files_subdir) / f.name for f in sources]
        (new / target.files_subdir).mkdir(parents=True)
        for source, path in zip(sources, paths, strict=True):
            shutil.copy2(source, new / path)
        filled = target.prompt_template.format(name=name, description=description, package_root=root, files_abs_list="\n".join(f"- `{root / p}`" for p in paths))
        (new / "PROMPT.md").write_text(filled, encoding="utf-8")
        if root.exists():
            root.rename(Path(made) / "replaced")
        new.rename(root)
    return root


def default_description(files: list[str]) -> str:
    """What a package is about if nobody says so: the first three files by name."""
    return "Reference material from: " + ", ".join(Path(f).stem for f in files[:3]) + ("…" if len(files) > 3 else "")
