"""Schemas of a typed architecture graph, and its fixed vocabularies."""

from __future__ import annotations

_ATTRIBUTE = "struct<name:string, description:string, value:string, content:string>"
_ELEMENT = (
    f"struct<id:string, name:string, type:string, parent:string, alias:string, classifier:string, description:string, attributes:array<{_ATTRIBUTE}>, "
    "subdiagram_views:array<struct<view_id:string, view_name:string>>, "
    "testcases:array<struct<name:string, description:string, type:string, Input:string, acceptanceCriteria:string, TestResults:string>>>"
)
_RELATIONSHIP = (
    "struct<id:string, statement:string, name:string, type:string, source_id:string, target_id:string, source_name:string, target_name:string, "
    "description:string, document:string, attributes:array<struct<name:string, description:string>>>"
)
_VIEW = "struct<view_id:string, view_name:string, parent_element_id:string, parent_element_name:string, description:string, included_elements:array<string>, included_relationships:array<string>>"

#: A graph document, as nested JSON.
DOCUMENT = (
    f"name string, description string, attributes array<{_ATTRIBUTE}>, elements array<{_ELEMENT}>, relationships array<{_RELATIONSHIP}>, views array<{_VIEW}>"
)

#: What ids look like.
ID_PATTERN = "^[A-Za-z0-9][A-Za-z0-9._-]*$"
#: Members that a view may have.
VIEW_LIMIT = 15
ROOT_VIEW = "SystemArchitecture"

# Element types by layer, relationship types, directions.
LAYERS = {
    "Strategy": ["Resource", "Capability", "Value Stream", "Course of Action"],
    "Business": [
        "Business Actor", "Business Role", "Business Collaboration", "Business Interface", "Business Process", "Business Function", "Business Interaction",
        "Business Event", "Business Service", "Business Object", "Contract", "Representation", "Product",
    ],
    "Application": [
        "Application Component", "Application Collaboration", "Application Interface", "Application Process", "Application Function",
        "Application Interaction", "Application Event", "Application Service", "Data Object",
    ],
    "Technology": [
        "Node", "Device", "System Software", "Technology Collaboration", "Technology Interface", "Path", "Communication Network", "Technology Process",
        "Technology Function", "Technology Interaction", "Technology Event", "Technology Service", "Artifact",
    ],
    "Physical": ["Equipment", "Facility", "Distribution Network", "Material"],
    "Motivation": ["Stakeholder", "Driver", "Assessment", "Goal", "Outcome", "Principle", "Requirement", "Constraint", "Meaning", "Value"],
    "Implementation": ["Work Package", "Deliverable", "Implementation Event", "Plateau", "Gap"],
    "Composite": ["Grouping", "Location"],
    "Junction": ["And Junction", "Or Junction"],
    "Agent": ["Skill", "Rule"],
}
ELEMENT_TYPES = [t for types in LAYERS.values() for t in types]
RELATIONSHIP_TYPES = ["Association", "Composition", "Aggregation", "Assignment", "Realization", "Serving", "Access", "Influence", "Triggering", "Flow", "Specialization"]
SOURCE_DEPENDS = ["Access", "Assignment", "Specialization", "Composition", "Aggregation"]
TARGET_DEPENDS = ["Serving", "Realization", "Flow", "Triggering", "Influence"]
SYMMETRIC = ["Association"]
