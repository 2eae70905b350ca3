"""The extraction ontology: kinds of entities with their keywords, gazetteers, and relationship triggers."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keywords by entity type.
ENTITY_TYPES: dict[str, tuple[str, ...]] = {
    "Document": (),
    "Application": ("application", "app", "portal", "platform"),
    "System": ("system",),
    "Service": ("service", "microservice"),
    "Database": ("database", "db", "datastore", "store"),
    "API": ("api", "endpoint", "gateway"),
    "Process": ("process", "workflow", "pipeline"),
    "Team": ("team", "squad", "department"),
    "Technology": ("framework", "language", "protocol"),
    "Policy": ("policy", "standard", "guideline", "compliance"),
    "Role": ("adult", "holder", "customer"),
    "Product": ("isa", "jisa", "ctf", "account"),
    "ExternalPartner": ("mail", "office"),
    "Tool": ("finder",),
    "Check": ("authentication", "verification", "check"),
    "Party": ("contact", "beneficiary", "donor"),
    "Channel": ("ivr", "branch", "telephony"),
    "Topic": (),
}
# Names that are technologies whatever their last word is.
TECHNOLOGIES = (
    "Kubernetes", "Docker", "PostgreSQL", "MySQL", "MongoDB", "Redis", "Kafka", "Java", "Python", "Node.js",
    "React", "GraphQL", "gRPC", "AWS", "Azure", "GCP", "OAuth2", "TensorFlow", "Terraform", "Linux",
)
# Acronyms with their entity type, matched by exact case.
DOMAIN_TERMS = {
    "IVR": "Channel", "CAT": "Check", "SAMM": "System", "COA": "Process", "FATCA": "Policy", "DIP": "Product", "TMW": "ExternalPartner", "CCBS": "ExternalPartner",
}
# Phrases that stand for a relationship.
RELATIONSHIP_TYPES: dict[str, tuple[str, ...]] = {
    "USES": ("uses", "utilizes", "leverages", "relies on"),
    "DEPENDS_ON": ("depends on", "is dependent on", "requires"),
    "CONNECTS_TO": ("connects to", "integrates with", "communicates with"),
    "OWNS": ("owns", "is responsible for", "maintains"),
    "CONTAINS": ("contains", "includes", "comprises"),
    "IMPLEMENTS": ("implements", "adheres to", "follows"),
    "REFERENCES": ("references", "refers to", "cites"),
    "REFERS_TO": ("refer to", "refer them to", "redirect to", "redirected to"),
    "ESCALATES_TO": ("escalate to", "escalated to", "hand over to", "handover to", "transfer to"),
    "REQUIRES": ("must", "need to", "needs to"),
    "APPLIES_TO": ("applies to", "for accounts with", "for customers with"),
}
# Words with several meanings.
AMBIGUOUS_TERMS: dict[str, tuple[str, ...]] = {
    "bank": ("Financial Institution", "River Bank"),
    "platform": ("Technology Platform", "Business Division", "Physical Platform"),
    "service": ("Microservice", "Business Service", "Customer Service"),
    "gateway": ("API Gateway", "Network Gateway", "Payment Gateway"),
    "pipeline": ("Data Pipeline", "CI/CD Pipeline", "Business Process Pipeline"),
    "store": ("Database Store", "Retail Store", "Object Store"),
    "policy": ("Business Policy", "Security Policy", "Insurance Policy"),
    "process": ("Business Process", "Operating System Process", "Manufacturing Process"),
    "domain": ("Business Domain", "Network Domain", "Email Domain"),
    "cluster": ("Kubernetes Cluster", "Database Cluster", "Business Cluster"),
}


def literal_map(values: dict[str, Any]) -> Column:
    """A map literal; small dictionaries travel with the plan and need no join."""
    if not values:
        return F.create_map().cast("map<string,string>")
    lit = lambda v: F.array(*[F.lit(x) for x in v]) if isinstance(v, tuple | list) else F.lit(v)
    return F.create_map(*[x for k, v in values.items() for x in (F.lit(k), lit(v))])


@dataclass(frozen=True)
class Ontology:
    """What extraction looks for. The lookups are literals of a size fixed by the ontology."""

    entity_types: dict[str, tuple[str, ...]] = field(default_factory=lambda: ENTITY_TYPES)
    technologies: tuple[str, ...] = TECHNOLOGIES
    domain_terms: dict[str, str] = field(default_factory=lambda: DOMAIN_TERMS)
    relationship_types: dict[str, tuple[str, ...]] = field(default_factory=lambda: RELATIONSHIP_TYPES)
    ambiguous_terms: dict[str, tuple[str, ...]] = field(default_factory=lambda: AMBIGUOUS_TERMS)

    @staticmethod
    def load(path: str) -> Ontology:
        """From a YAML file with entity_types, technology_gazetteer, domain_gazetteer and relationship_types."""
        import yaml

        with open(path, encoding="utf-8") as f:
            raw = yaml.safe_load(f) or {}
        kinds = {k: tuple((v or {}).get("keywords") or ()) for k, v in (raw.get("entity_types") or {}).items()}
        triggers = {k: tuple((v or {}).get("triggers") or ()) for k, v in (raw.get("relationship_types") or {}).items()}
        return Ontology(kinds, tuple(raw.get("technology_gazetteer") or ()), dict(raw.get("domain_gazetteer") or {}), triggers)

    @property
    def keywords(self) -> dict[str, str]:
        """Keyword to type; of a keyword under several types the last one counts."""
        return {w.lower(): t for t, ws in self.entity_types.items() for w in ws}

    @property
    def triggers(self) -> list[tuple[str, str]]:
        """(relationship type, trigger), longest trigger first."""
        return sorted(((t, w.lower()) for t, ws in self.relationship_types.items() for w in ws), key=lambda p: -len(p[1]))

    def type_of(self, keyword: Column) -> Column:
        return F.try_element_at(literal_map(self.keywords), keyword)

    def is_technology(self, phrase: Column) -> Column:
        names = [t.lower() for t in self.technologies]
        return phrase.isin(*names) if names else F.lit(False)

    def domain_type(self, token: Column) -> Column:
        return F.try_element_at(literal_map(self.domain_terms), token)
