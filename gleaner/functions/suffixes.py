"""Public suffix rules: which trailing labels of a host are a registry's, not a site's.

The rules are a parameter everywhere they are used.  The set below covers the
registries of about 75 countries; pass ``parse_rules(lines)`` of a full list to replace it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterable
from dataclasses import dataclass

# Second-level registry labels per country code, one country a line; ``*`` stands
# for every label, and a label after ``!`` is a site after all.
REGISTRIES = """
ar: bet com coop edu gob gov int mil net org tur
at: ac co gv or
au: asn com edu gov id net org
bd: *
bo: com edu gob gov int mil net org tv
br: art blog com eco edu gov ind mil net org
ci: ac co com ed edu go gov int net or org
ck: * !www
cn: ac com edu gov mil net org
co: com edu gov mil net nom org
cr: ac co ed fi go or sa
cy: ac biz com gov ltd net org press pro
do: art com edu gob gov mil net org sld web
ec: com edu fin gob gov info med mil net org pro
eg: com edu eng gov mil name net org sci
er: *
es: com edu gob nom org
fk: *
gh: com edu gov mil org
gr: com edu gov net org
gt: com edu gob ind mil net org
hk: com edu gov idv net org
hn: com edu gob mil net org
hu: co info org priv tm web
id: ac biz co desa go mil my net or sch web
il: ac co gov k12 muni net org
in: ac co edu firm gen gov ind mil net nic org res
it: edu gov
jm: *
jp: ac ad co ed go gr lg ne or
ke: ac co go info me mobi ne or sc
kh: *
kr: ac co es go hs kg mil ms ne or pe re sc
kw: com edu gov ind net org
kz: com edu gov mil net org
lb: com edu gov net org
lk: ac assn com edu gov int net org sch web
ma: ac co gov net org press
mm: *
mt: com edu net org
mx: com edu gob net org
my: biz com edu gov mil name net org
ng: com edu gov i mil mobi name net org sch
ni: ac co com edu gob mil net nom org web
np: *
nz: ac co geek gen govt iwi kiwi maori mil net org school
om: co com edu gov med museum net org pro
pa: ac com edu gob net nom org sld
pe: com edu gob mil net nom org
pg: *
ph: com edu gov i mil net ngo org
pk: biz com edu fam gov net org web
pl: com edu gov info net org
pt: com edu gov int net nome org publ
py: com coop edu gov mil net org
qa: com edu gov mil name net org sch
rs: ac co edu gov in org
sa: com edu gov med net org pub sch
sg: com edu gov net org per
sv: com edu gob org red
th: ac co go in mi net or
tn: com edu ens fin gov ind info net org
tr: av bel biz com edu gen gov info k12 mil name net org pol tel tv web
tw: com edu gov idv mil net org
tz: ac co go me mobi ne or sc
ua: com edu gov in net org
ug: ac co com go ne or org sc
uk: ac co gov ltd me net nhs org plc police sch
uy: com edu gub mil net org
uz: co com net org
ve: co com edu gob gov info mil net org web
vn: ac biz com edu gov health info int name net org pro
za: ac co edu gov law mil net nom org school web
zm: ac co com edu gov net org
zw: ac co gov mil org
"""


@dataclass(frozen=True)
class SuffixRules:
    """Rules by number of labels, so that each host tail is tested by one set lookup."""

    exact: dict[int, list[str]]
    wildcard: dict[int, list[str]]
    exception: dict[int, list[str]]

    @property
    def depth(self) -> int:
        """Most labels a public suffix of this rule set can have."""
        return max([1, *self.exact, *(k + 1 for k in self.wildcard), *self.exception])


def parse_rules(lines: Iterable[str]) -> SuffixRules:
    """Rules from lines such as ``co.uk``, ``*.ck``, ``!www.ck``; ``//`` starts a comment."""
    kinds = {"": defaultdict(set), "*.": defaultdict(set), "!": defaultdict(set)}
    for line in lines:
        rule = line.split("//")[0].strip().lower()
        if not rule:
            continue
        mark = "*." if rule.startswith("*.") else "!" if rule.startswith("!") else ""
        name = rule[len(mark):]
        kinds[mark][name.count(".") + 1].add(name)
    return SuffixRules(*({k: sorted(v) for k, v in kind.items()} for kind in kinds.values()))


def _shipped_lines() -> Iterable[str]:
    for line in REGISTRIES.strip().splitlines():
        country, labels = line.split(":")
        yield country
        for label in labels.split():
            yield f"!{label[1:]}.{country}" if label.startswith("!") else f"{label}.{country}"


SHIPPED_RULES = parse_rules(_shipped_lines())
