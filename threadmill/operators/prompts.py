"""Prompt columns. The wording is data: every builder takes its template, and the defaults are ours."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import falsy_to

GUIDELINES = (
    "Write the way people in the forum write: a few short sentences on one aspect of the post. Do not state your role or credentials, "
    "and leave out disclaimers and advice to see a professional. A layperson's reply need not be medically right.\n"
)


@dataclass(frozen=True)
class Templates:
    """{title}, {body}, {n}, {role}, {mix} and {prior} are filled in; what a template does not name is left out."""

    thread: str = "Post title: {title}\nPost: {body}\n\nWrite exactly {n} replies to this post, {mix}.\n" + GUIDELINES + 'Answer in JSON: {"comments": [{"body": "...", "author_type": "..."}]}'
    single: str = "Post title: {title}\nPost: {body}\n\nWrite one reply to this post by a {role}.\n" + GUIDELINES + 'Answer in JSON: {"comments": [{"body": "...", "author_type": "..."}]}'
    incremental: str = "Post title: {title}\nPost: {body}\n\nReplies so far:\n{prior}\nWrite the next reply, by a {role}; do not repeat what was said.\n" + GUIDELINES + 'Answer in JSON: {"comments": [{"body": "...", "author_type": "..."}]}'


#: Three fixed mixtures of roles.
RATIO_ARMS = {"synthetic_75_clinician": "of which 75% are by clinicians and 25% by laypersons", "synthetic_25_clinician": "of which 25% are by clinicians and 75% by laypersons", "synthetic_no_ratio": "by any mix of clinicians and laypersons"}


def fill(template: str, **values: Column) -> Column:
    """The template as a column, each {name} replaced by its value; other braces stay."""
    parts, rest = [], template
    while rest:
        found = min(((rest.find("{" + n + "}"), n) for n in values if "{" + n + "}" in rest), default=None)
        if found is None:
            parts.append(F.lit(rest))
            break
        at, name = found
        if at:
            parts.append(F.lit(rest[:at]))
        parts.append(F.coalesce(values[name].cast("string"), F.lit("")))
        rest = rest[at + len(name) + 2 :]
    return F.concat(*parts) if parts else F.lit("")


def role_mix(clinician: Column, layperson: Column) -> Column:
    """The sentence on roles: all clinicians, all laypersons, or both counts."""
    return F.when(layperson == 0, "all by clinicians").when(clinician == 0, "all by laypersons").otherwise(F.concat(clinician.cast("string"), F.lit(" by clinicians and "), layperson.cast("string"), F.lit(" by laypersons")))


def prior_text(prior: Column) -> Column:
    """Numbered replies from an array of bodies."""
    return F.array_join(F.transform(prior, lambda c, i: F.concat(F.lit("Comment "), (i + 1).cast("string"), F.lit(": "), c, F.lit("\n\n"))), "")


def thread_prompt(templates: Templates = Templates(), mix: Column | None = None) -> Column:
    return fill(templates.thread, title=falsy_to("title", ""), body=falsy_to("selftext", ""), n=F.col("n_comments"), mix=mix if mix is not None else F.lit("all by clinicians"))


def single_prompt(role: Column, templates: Templates = Templates()) -> Column:
    return fill(templates.single, title=falsy_to("title", ""), body=falsy_to("selftext", ""), role=role)


def incremental_prompt(role: Column, prior: Column, templates: Templates = Templates()) -> Column:
    return fill(templates.incremental, title=falsy_to("title", ""), body=falsy_to("selftext", ""), role=role, prior=prior_text(prior))
