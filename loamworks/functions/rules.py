"""Rules over lower-cased text as SQL expressions that both engines read."""

from __future__ import annotations

from . import markers as M


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def any_of(x: str, words: tuple[str, ...], d=None) -> str:
    text = d.text if d else quoted
    return "(" + " OR ".join(f"contains({x}, {text(w)})" for w in words) + ")"


def count_of(x: str, words: tuple[str, ...], d=None) -> str:
    text = d.text if d else quoted
    return "(" + " + ".join(f"CAST(contains({x}, {text(w)}) AS INT)" for w in words) + ")"


def starts(x: str, words: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"substr({x}, 1, {len(w)}) = {quoted(w)}" for w in words) + ")"


class Rules:
    """Predicates of one lower-case column."""

    def __init__(self, d, x: str = "l"):
        self.d, self.x = d, x

    def any(self, words: tuple[str, ...]) -> str:
        return any_of(self.x, words, self.d)

    def count(self, words: tuple[str, ...]) -> str:
        return count_of(self.x, words, self.d)

    # -- memory markers and requests
    def explicit(self) -> str:
        return self.any(M.EXPLICIT_MEMORY)

    def strong(self) -> str:
        return self.any(M.STRONG_MEMORY)

    def unresolved(self) -> str:
        return f"({self.any(M.UNRESOLVED)} OR ({self.any(M.WEAK_REQUEST)} AND NOT {self.any(M.WEAK_TOPICS)}))"

    def monologue(self) -> str:
        words = f"{self.d.size}({self.d.all_of(self.x, '[^ \t\n\r]+')})"
        return f"({self.any(M.MONOLOGUE)} AND {words} < 15 AND NOT {self.any(M.MONOLOGUE_NOUNS)})"

    def one_off(self) -> str:
        return f"({starts(self.x, M.REQUEST_STARTS)} AND NOT {self.explicit()} AND NOT {self.strong()})"

    def code_lines(self) -> str:
        """How many lines look like code or are empty."""
        d, e = self.d, self.d.replaced("e", "^[ \t\r\x0b\x0c]+|[ \t\r\x0b\x0c]+$")
        begins = " OR ".join(f"substr({e}, 1, {len(w)}) = {quoted(w)}" for w in M.CODE_STARTS)
        holds = " OR ".join(f"contains(e, {quoted(w)})" for w in M.CODE_SIGNS)
        code = f"{e} = '' OR {begins} OR {holds} OR (substr({e}, -1, 1) = ';' AND NOT {starts(e, M.CODE_TALK)})"
        return f"{d.size}({d.kept(self.lines(), code)})"

    def lines(self) -> str:
        return self.d.pieces(f"trim({self.x})", "\n")

    def code_block(self) -> str:
        """At least three lines, over 80 of 100 of them code. A text of one line is none, whatever it holds."""
        n = f"{self.d.size}({self.lines()})"
        return f"CASE WHEN contains({self.x}, chr(10)) THEN {n} >= 3 AND {self.code_lines()} * 100 >= {n} * 81 ELSE FALSE END"

    def low_value(self) -> str:
        return f"({self.any(M.NOISE)} OR {self.code_block()} OR {self.monologue()} OR {self.one_off()} OR ({self.unresolved()} AND NOT {self.explicit()}))"

    # -- the nine signals, in the order in which they are listed
    def signals(self) -> tuple[tuple[str, str], ...]:
        steps, actions = self.count(M.WORKFLOW_STEPS), self.count(M.WORKFLOW_ACTIONS)
        topics = self.count(M.PLANNING_TOPICS)
        improvement = f"(NOT ({self.unresolved()} AND NOT {self.any(M.IMPROVEMENT_DONE)} AND NOT {self.explicit()}) AND {self.any(M.IMPROVEMENT_OUTCOME)} AND {self.any(M.IMPROVEMENT_PROJECT)})"
        return (
            ("preference", f"({self.any(M.PREFERENCE_DURABLE)} AND {self.any(M.PREFERENCE_TOOLS)})"),
            ("constraint", f"({self.any(M.CONSTRAINT)} AND {self.any(M.CONSTRAINT_REASON)})"),
            ("project_improvement", improvement),
            ("workflow", f"({steps} >= 2 OR ({steps} >= 1 AND {actions} >= 2) OR {actions} >= 3)"),
            ("architecture_decision", f"({self.any(M.DECISION)} AND {self.any(M.DECISION_REASON)})"),
            ("principle", f"({self.any(M.PRINCIPLE_TOPICS)} AND {self.any(M.PRINCIPLE_STANCE)})"),
            ("planning_heuristic", f"({topics} >= 1 AND ({self.any(M.PLANNING_ORDER)} OR {topics} >= 2))"),
            ("collaboration_preference", f"({self.any(M.COLLABORATION_TOPICS)} AND {self.any(M.COLLABORATION_WISH)})"),
            ("explicit_memory", self.explicit()),
        )

    # -- gate and classification
    def gate(self) -> str:
        """The reason of the first rule that rejects, or null."""
        return (
            f"CASE WHEN {self.any(M.SOFT_PERSONALITY)} AND NOT {self.any(M.OPERATIONAL)} THEN 'soft-personality-without-operational-trigger'"
            f" WHEN {self.any(M.GATE_ONE_OFF)} THEN 'one-off-task'"
            f" WHEN {self.any(M.GATE_GENERIC)} OR (contains({self.x}, '代码整洁') AND contains({self.x}, '文档完善')) THEN 'generic-advice-without-local-trigger'"
            f" WHEN {self.any(M.GATE_UNRESOLVED)} THEN 'unresolved-request'"
            f" WHEN {self.any(M.GATE_LOG)} THEN 'prompt-or-log-noise' END"
        )

    def signal(self) -> str:
        both = lambda a, b: f"(contains({self.x}, {quoted(a)}) AND contains({self.x}, {quoted(b)}))"
        noise = f"{both('代码整洁', '文档完善')} OR {self.any(M.CLASS_ONE_OFF)} OR {self.any(M.CLASS_UNRESOLVED)} OR {self.any(M.CLASS_SHELL)}"
        cases = (
            ("", noise),
            ("ai_project_improvement", f"{self.any(M.ACCEPTED)} AND {self.any(M.ACCEPTED_PROJECT)} AND {self.any(M.ACCEPTED_GOVERNANCE)}"),
            ("correction", f"{self.any(M.CORRECTION_SLIP)} AND {self.any(M.CORRECTION_TEST)} AND {self.any(M.CORRECTION_PREVENT)}"),
            ("decision", f"{self.any(M.CLASS_DECISION)} AND {self.any(M.CLASS_DECISION_TOPIC)}"),
            ("validation", f"{self.any(M.VALIDATION_WHAT)} AND {self.any(M.VALIDATION_WHEN)}"),
            ("template", f"{self.any(M.TEMPLATE_WHAT)} AND {self.any(M.TEMPLATE_WHO)}"),
            ("constraint", f"NOT contains({self.x}, '不要再') AND {self.any(M.CLASS_CONSTRAINT)}"),
            ("preference", f"({self.any(M.CLASS_PREFERENCE)} OR {starts(self.x, ('use ',))}) AND {self.any(M.CLASS_TOOLS)}"),
            ("procedure", f"{both('先', '再')} OR {both('first', 'then')} OR {self.any(M.PROCEDURE)}"),
        )
        return "CASE " + " ".join(f"WHEN {c} THEN '{n}'" for n, c in cases) + " ELSE '' END"

    def artifact(self, signal: str) -> str:
        more = f"({self.any(M.SUPPLEMENT)} OR (contains({self.x}, 'skill') AND contains({self.x}, '补充')))"
        return f"CASE WHEN {signal} = '' THEN 'reject' WHEN {signal} = 'ai_project_improvement' THEN 'review_only' WHEN {more} THEN 'skill_supplement' WHEN {signal} IN ('template', 'procedure') THEN 'workflow_skill' ELSE 'always_on_rule' END"

    def hardness(self, signal: str, artifact: str) -> str:
        return (
            f"CASE WHEN {self.any(M.CRITICAL)} THEN 'critical'"
            f" WHEN {signal} IN ('constraint', 'correction', 'decision', 'validation', 'ai_project_improvement') OR {artifact} = 'review_only' OR {self.any(M.HIGH)} THEN 'high'"
            f" WHEN {artifact} IN ('workflow_skill', 'skill_supplement') OR {signal} IN ('procedure', 'template') THEN 'medium' ELSE 'low' END"
        )

    @staticmethod
    def activation(artifact: str) -> str:
        return f"CASE WHEN {artifact} IN ('workflow_skill', 'skill_supplement') THEN 'skill' WHEN {artifact} = 'review_only' THEN 'manual' WHEN {artifact} = 'always_on_rule' THEN 'always_on' ELSE 'model_decision' END"

    def control(self, signal: str, hardness: str) -> str:
        return (
            f"CASE WHEN {signal} IN ('constraint', 'ai_project_improvement') OR {self.any(('不要', 'do not'))} THEN 'prohibition'"
            f" WHEN {signal} IN ('procedure', 'template', 'validation', 'correction') OR {self.any(M.CHECKLIST)} THEN 'checklist'"
            f" WHEN {hardness} IN ('high', 'critical') THEN 'exact_sequence' WHEN {signal} = 'preference' THEN 'default' ELSE 'principle' END"
        )

    def tags(self) -> str:
        """An array with nulls, over columns signal, artifact_kind, activation and hardness."""
        shape = f"CASE WHEN signal <> 'ai_project_improvement' THEN signal WHEN {self.any(('evidencechunk', '漏斗'))} THEN 'decision' WHEN contains({self.x}, '不是直接写') THEN 'constraint' ELSE signal END"
        when = lambda c, t: f"CASE WHEN {c} THEN '{t}' END"
        return self.d.array(
            f"concat('shape:', {shape})",
            "concat('hardness:', hardness)",
            "concat('activation:', replace(activation, '_', '-'))",
            when("artifact_kind = 'always_on_rule'", "target:agents-md"),
            when("artifact_kind IN ('workflow_skill', 'skill_supplement')", "target:skill-dir"),
            *[when(self.any(w), t) for t, w in M.TAGS],
            when(f"signal = 'ai_project_improvement' AND contains({self.x}, '用户确认')", "evidence:accepted-ai"),
            when("signal = 'correction'", "evidence:user-correction"),
            when("signal IN ('validation', 'correction')", "shape:validation"),
        )

    # -- scoring: terms in the order of their names, which is the order of addition
    def terms(self) -> tuple[tuple[str, str], ...]:
        f = lambda *cases, other=0.0: "CAST(CASE " + " ".join(f"WHEN {c} THEN {v}" for c, v in cases) + f" ELSE {other} END AS FLOAT)"
        twice = f"(length({self.x}) - length(replace({self.x}, '以后', ''))) >= 4"
        return (
            ("actionability", f(("control IN ('exact_sequence', 'checklist', 'prohibition')", 0.8), ("control = 'default'", 0.5), ("control = 'principle'", 0.3), other=0.2)),
            ("fragility_value", f(("signal = 'constraint' AND " + self.any(("不要",)), 0.4), (self.any(M.FRAGILITY), 0.3))),
            ("future_agent_value", f(("signal IN ('constraint', 'correction')", 1.4), ("signal IN ('decision', 'ai_project_improvement')", 1.2), ("signal IN ('procedure', 'validation')", 1.0), ("signal IN ('preference', 'template')", 0.8), other=0.2)),
            ("generic_advice_penalty", f((f"contains({self.x}, '代码整洁') AND contains({self.x}, '文档完善')", -2.0))),
            ("grounding", f(("hardness = 'critical'", 0.8), ("hardness = 'high'", 0.6), ("hardness = 'medium'", 0.4), other=0.2)),
            ("novelty", f(("signal IN ('ai_project_improvement', 'decision')", 0.5), ("signal IN ('correction', 'validation')", 0.3), other=0.1)),
            ("one_off_penalty", f((self.any(M.CLASS_ONE_OFF), -2.0))),
            ("prompt_leak_penalty", "CAST(0.0 AS FLOAT)"),
            ("recurrence_or_correction", f(("signal = 'correction'", 1.2), (f"{self.any(M.RECURRENCE)} OR {twice}", 0.6))),
            ("sensitive_content_penalty", f((self.any(M.SENSITIVE), -2.0))),
            ("specificity", f((f"{self.any(M.SPECIFIC_PRINCIPLES)} OR {self.any(M.SPECIFIC_TERMS)}", 0.7), other=0.2)),
            ("transcript_noise_penalty", f((self.any(("error[", "--> src/")), -1.5))),
            ("trigger_clarity", f(("activation = 'always_on'", 1.0), ("activation = 'skill'", 0.7), ("activation = 'manual'", 0.4), other=0.3)),
            ("unresolved_penalty", f((self.any(M.CLASS_UNRESOLVED), -1.5))),
            ("validation_value", f(("signal = 'validation'", 0.8), (self.any(M.VALIDATION_TERMS), 0.5))),
        )
