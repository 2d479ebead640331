"""Column -> Column classification of resources, roles, scopes, identities, intents and issuers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkseam.functions.text import contains_any, first_match

# Provider by resource type prefix.
PROVIDER_PREFIXES = {"aws": "aws", "azurerm": "azure", "azuread": "azure", "azurestack": "azure", "google": "gcp", "kubernetes": "k8s", "helm": "k8s"}
# Provider by the first group with a keyword in lower-case content and path.
PROVIDER_KEYWORDS = [
    ("aws", ["amazonaws", '"aws_', "aws-", "us-east-", "us-west-", "eu-west-"]),
    ("azure", ["azure", "microsoft", "azurewebsites", "azureedge"]),
    ("gcp", ["googleapis", '"google_', "gcp", "gcloud", "cloudfunctions"]),
    ("k8s", ["kubernetes", "k8s", "kubectl", "apiversion", "kind:"]),
]
# One provider vocabulary.
PROVIDER_ALIASES = {"google": "gcp", "k8s": "kubernetes", "": "unknown"}
# Category by the first group with a keyword.
CATEGORIES = [
    ("storage", ["storage", "bucket", "blob", "disk", "volume", "efs", "s3"]),
    ("identity", ["identity", "iam", "role", "rbac", "oidc", "service_account", "principal"]),
    ("networking", ["network", "subnet", "security_group", "firewall", "nsg", "vpc", "load_balancer", "gateway"]),
    ("secrets", ["secret", "key_vault", "kms", "secret_manager", "credential", "password", "token"]),
    ("compute", ["instance", "vm", "compute", "lambda", "function", "pod", "container", "cluster", "deployment"]),
]
# Intent by the first group with a keyword.
INTENTS = [
    ("iam", ["managed identity", "managed identities", "role assignment", "contributor", "owner role", "rbac", "service principal", "iam",
        "permission", "access policy", "privilege escalation", "azurerm_role_assignment", "aws_iam_role", "google_iam_binding"]),
    ("workload_identity", ["oidc", "workload identity", "federation", "issuer", "audience", "subject claim", "trust policy", "federated credential",
        "azurerm_federated_identity_credential"]),
    ("secrets", ["secret", "password", "api key", "api_key", "token", "credential", "hardcoded", "entropy", "private key", "connection string",
        "connection_string", "sas_token", "oauth_token", "client_secret", "access_key", "pat", "bearer"]),
    ("prompt_injection", ["prompt injection", "github actions", "azure devops", "ci/cd", "workflow yaml", "run:", "script:", "${{", "actions_runner",
        "untrusted input", "github.event", "pull_request_target"]),
    ("network", ["security group", "open port", "0.0.0.0", "ingress", "egress", "firewall", "public access", "acl", "nsg",
        "azurerm_network_security_rule", "azurerm_network_security_group", "aws_security_group", "allow all", "port 22", "port 3389", "unrestricted",
        "cidr_blocks", "source_port_ranges"]),
    ("compliance", ["cis", "compliance", "benchmark", "policy", "standard", "regulation", "pci", "hipaa", "nist", "soc2", "gdpr", "iso27001"]),
]
DEFAULT_INTENT = "general_security"
# Built-in role ids; a repeated id keeps the later name.
ROLE_IDS = {
    "8e3af657-a8ff-443c-a75c-2fe8c4bcb635": "Owner",
    "b24988ac-6180-42a0-ab88-20f7382dd24c": "Contributor",
    "acdd72a7-3385-48ef-bd42-f606fba81ae7": "Reader",
    "ba92f5b4-2d11-453d-a403-e96b0029c9fe": "Storage Blob Data Contributor",
    "2a2b9908-6ea1-4ae2-8e65-a410df84e7d1": "Storage Blob Data Reader",
    "974c5e8b-45b9-4653-ba55-5f855dd0fb88": "Storage Queue Data Contributor",
    "9980e02c-c2be-4d73-94e8-173b1dc7cf3c": "Virtual Machine Contributor",
    "fb879df8-f326-4884-b1cf-06f3ad86be52": "Virtual Machine Administrator Login",
    "992aa8b3-b645-451c-88c6-62fd8b5a73af": "Key Vault Secrets User",
    "4633458b-17de-408a-b874-0445c86b69e6": "Key Vault Secrets Officer",
    "21090545-7ca7-4776-b22c-e363652d74d2": "Key Vault Reader",
    "00c29273-979b-4161-815c-10b084fb9324": "Key Vault Certificates Officer",
    "18d7d88d-d35e-4fb5-a5c3-7773c20a72d9": "User Access Administrator",
    "749f88d5-cbae-40b8-bcfc-e573ddc772fa": "Monitoring Contributor",
    "92aaf0da-9dab-42b6-933f-5effd83a5c5c": "Log Analytics Reader",
    "3913510d-42f4-4e42-8a64-420c390055eb": "Monitoring Metrics Publisher",
}
# Hints in scope expressions, in this order.
SUBSCRIPTION_HINTS = ["data.azurerm_subscription", "azurerm_subscription.", ".subscription_id", "subscription().id", "subscriptionresourceid("]
GROUP_HINTS = ["azurerm_resource_group.", "resourcegroup().id", ".resource_group_id", "/resourcegroups"]
# Issuers inside the trust boundary.
TRUSTED_HOSTS = ["azure.com", "azmk8s.io", "kubernetes.default.svc"]
UUID = "(?i)([0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"


def lookup(key: Column, table: dict, default: Column) -> Column:
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


def provider(resource_type: Column, content: Column, path: Column) -> Column:
    """aws, azure, gcp, k8s or unknown: by the type's prefix, else by keywords."""
    prefix = F.lower(F.substring_index(F.coalesce(resource_type, F.lit("")), "_", 1))
    probe = F.lower(F.concat(F.coalesce(content, F.lit("")), F.lit(" "), F.coalesce(path, F.lit(""))))
    return lookup(prefix, PROVIDER_PREFIXES, first_match(probe, PROVIDER_KEYWORDS, "unknown"))


def provider_alias(name: Column) -> Column:
    low = F.lower(F.coalesce(name, F.lit("")))
    return lookup(low, PROVIDER_ALIASES, low)


def resource_type(file_type: Column, text: Column) -> Column:
    resource = F.regexp_extract(text, r'resource\s+"([^"]+)"\s+"[^"]+"', 1)
    data = F.regexp_extract(text, r'data\s+"([^"]+)"\s+"[^"]+"', 1)
    kind = F.regexp_extract(text, r"(?m)^kind\s*:\s*([A-Za-z0-9_\-]+)", 1)
    low = F.lower(F.coalesce(file_type, F.lit("")))
    return F.when(low == "terraform", F.when(resource != "", resource).otherwise(data)).when(low.isin("yaml", "yml", "json"), kind).otherwise("")


def category(kind: Column, text: Column) -> Column:
    return first_match(F.lower(F.concat(F.coalesce(kind, F.lit("")), F.lit(" "), F.coalesce(text, F.lit("")))), CATEGORIES, "general")


def filled(value: Column, other: Column) -> Column:
    """value unless it is null or empty."""
    return F.coalesce(F.nullif(value, F.lit("")), other)


def intent(query: Column) -> Column:
    return first_match(F.lower(F.coalesce(query, F.lit(""))), INTENTS, DEFAULT_INTENT)


def routed(query: Column, label: Column) -> Column:
    """A model's label if there is one (an unknown one means the default), else keywords."""
    low = F.lower(F.trim(label))
    known = [name for name, _ in INTENTS] + [DEFAULT_INTENT]
    return F.when(F.coalesce(low, F.lit("")) == "", intent(query)).otherwise(F.when(low.isin(known), low).otherwise(DEFAULT_INTENT))


def unquoted(value: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(value, r"^\s+|\s+$", ""), "^[\"']+|[\"']+$", "")


def role_name(value: Column) -> Column:
    guid = F.lower(F.regexp_extract(value, UUID, 1))
    named = lookup(guid, ROLE_IDS, F.concat(F.lit("Unknown ("), guid, F.lit(")")))
    return F.when(F.coalesce(value, F.lit("")) == "", "Unknown").when(guid != "", named).otherwise(unquoted(value))


def scope_type(expr: Column) -> Column:
    """subscription, resource_group, resource or unknown."""
    s = unquoted(F.coalesce(expr, F.lit("")))
    low = F.lower(s)
    parts = F.size(F.filter(F.split(low, "/"), lambda x: x != ""))
    path = F.when(parts <= 2, "subscription").when(F.contains(low, F.lit("resourcegroup")), F.when(parts <= 4, "resource_group").otherwise(
        "resource")).otherwise("resource")
    return (
        F.when(F.coalesce(expr, F.lit("")) == "", "unknown")
        .when(F.startswith(low, F.lit("/subscriptions/")), path)
        .when(contains_any(low, SUBSCRIPTION_HINTS), "subscription")
        .when(contains_any(low, GROUP_HINTS), "resource_group")
        .when(low.rlike(r"^(var\.|local\.|param)"), "unknown")
        .when(F.contains(s, F.lit("/")), "resource")
        .otherwise("unknown")
    )


def identity_name(ref: Column, block: Column) -> Column:
    ref = F.coalesce(ref, F.lit(""))
    return filled(F.regexp_extract(ref, r"azurerm_\w+\.(\w+)\.", 1), filled(F.regexp_extract(ref, r"(?i)parameters?\(['\"](\w+)['\"]\)", 1), block))


def identity_type(ref: Column) -> Column:
    low = F.lower(F.coalesce(ref, F.lit("")))
    return (
        F.when(contains_any(low, ["user_assigned_identity", "userassignedidentity"]), "user_assigned")
        .when(contains_any(low, ["linux_virtual_machine", "windows_virtual_machine"]), "system_assigned")
        .when(F.contains(low, F.lit("service_principal")), "service_principal")
        .otherwise("unknown")
    )


def broad_subject(subject: Column) -> Column:
    s = F.coalesce(subject, F.lit(""))
    return F.contains(s, F.lit("*")) | s.rlike("^system:serviceaccount:[^:]+$")


def valid_https(url: Column) -> Column:
    return F.coalesce(url, F.lit("")).rlike("^(?i:https)://[^/?#]+")


def host_of(url: Column) -> Column:
    authority = F.regexp_extract(F.trim(F.coalesce(url, F.lit(""))), r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)
    return F.lower(F.regexp_replace(F.regexp_replace(authority, "^.*@", ""), ":[0-9]*$", ""))


def trusted_host(host: Column) -> Column:
    out = F.lit(False)
    for suffix in TRUSTED_HOSTS:
        out = out | (host == suffix) | F.endswith(host, F.lit("." + suffix))
    return out
