"""Review workflows: which prompt and which parameters a task for a reviewer carries."""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import DataFrame

from lumensift.operators import report
from lumensift.sources.config import load_yaml, overlaid

# The workflows, their prompt files and their parameters.
WORKFLOWS = {
    "security": ("security-audit-prompt.md", {"temperature": 0.1, "max_tokens": 2048, "top_p": 0.9, "model": "gpt-4"}, "安全审计工作流"),
    "quality": ("code-quality-prompt.md", {"temperature": 0.2, "max_tokens": 2048, "top_p": 0.9, "model": "gpt-4"}, "代码质量工作流"),
    "performance": ("performance-review-prompt.md", {"temperature": 0.1, "max_tokens": 2048, "top_p": 0.9, "model": "gpt-4"}, "性能优化工作流"),
    "architecture": ("architecture-review-prompt.md", {"temperature": 0.2, "max_tokens": 2048, "top_p": 0.9, "model": "gpt-4"}, "架构审查工作流"),
    "comprehensive": ("ai-enhancer-prompt.md", {"temperature": 0.1, "max_tokens": 1024, "top_p": 0.9, "model": "gpt-4"}, "综合评审工作流"),
}
#: What stands for a prompt file that isn't there.
DEFAULT_PROMPT = "Review each finding below against its code and say whether it is real. Answer with a JSON array, one entry for each finding, and nothing else."


def workflow_names() -> list[str]:
    return list(WORKFLOWS)


class Review:
    """A workflow with its parameters: a workflow's own, then those of a settings file, then the caller's."""

    def __init__(self, workflow: str = "comprehensive", prompts: str | None = None, params_file: str | None = None, **params):
        self.prompts, self.given = prompts, overlaid({}, self._of_file(params_file), params)
        self.workflow = workflow if workflow in WORKFLOWS else "comprehensive"

    @staticmethod
    def _of_file(path: str | None) -> dict:
        """A settings file that isn't there or can't be read changes nothing."""
        try:
            found = load_yaml(Path(path).read_text(encoding="utf-8")) if path else None
        except (OSError, ValueError):
            return {}
        return found if isinstance(found, dict) else {}

    def switch(self, workflow: str) -> bool:
        """Whether there is such a workflow; it is the current one then."""
        if workflow in WORKFLOWS:
            self.workflow = workflow
        return workflow in WORKFLOWS

    @property
    def params(self) -> dict:
        return overlaid(WORKFLOWS[self.workflow][1], self.given)

    @property
    def prompt(self) -> str:
        path = Path(self.prompts or "") / WORKFLOWS[self.workflow][0]
        if not self.prompts or not path.exists():
            return DEFAULT_PROMPT
        text = path.read_text(encoding="utf-8", errors="replace")
        quoted = re.search(r'"""(.*?)"""', text, re.DOTALL)
        return quoted[1].strip() if quoted else text

    def task(self, findings: DataFrame, changed: DataFrame, contract: str = "", feedback: dict | None = None, examples: list = ()) -> DataFrame:
        """The task's lines; findings are ranked, and dropped ones among them are left out by the caller."""
        return report.task_lines(findings, changed, contract, self.params, self.prompt, feedback, examples)
