"""Path patterns, signal rules, word lists and thresholds.

Patterns are matched against lower-cased paths unless a comment says otherwise.
They use only syntax that Java, RE2 and others read alike.
"""

from __future__ import annotations

# -- path areas: the first list with a match decides (fixed values) ---------------

TEST_PATTERNS = [
    r"\.spec\.[jt]sx?$",
    r"\.test\.[jt]sx?$",
    r"_(test|spec)\.[a-z0-9]+$",
    r"(^|/)__tests__(/|$)",
    r"(^|/)specs?(/|$)",
    r"(^|/)(e2e|playwright|cypress)(/|$)",
    r"playwright\.config\.[jt]s$",
]
DOC_PATTERNS = [
    r"(^|/)(docs|documentation)(/|$)",
    r"(^|/)(readme|changelog|contributing|license)(\.|$)",
    r"\.(md|mdx|rst|txt)$",
]
CONFIG_PATTERNS = [
    r"(^|/)(environment|env)(\.|/|-|_)",
    r"(^|/)\.env",
    r"(^|/)(config|configs)(/|$)",
    r"(^|/)(package|package-lock|pnpm-lock|yarn\.lock|tsconfig|vite\.config|webpack\.config|angular\.json|nx\.json|jest\.config|eslint\.config)",
    r"\.(json|ya?ml|toml|ini)$",
]
FRONTEND_PATTERNS = [
    r"(^|/)(src/app|components|component|pages|views|ui|styles|assets)(/|$)",
    r"\.(component|directive|pipe|module)\.ts$",
    r"\.(tsx|jsx|html|css|scss|sass|less)$",
]
BACKEND_PATTERNS = [
    r"(^|/)(api|server|backend|routes|controllers|middleware|models|repositories|migrations|db|database)(/|$)",
    r"\.(controller|resolver|route|middleware|model|schema)\.[jt]s$",
]
AREAS: list[tuple[str, list[str]]] = [
    ("tests", TEST_PATTERNS),
    ("docs", DOC_PATTERNS),
    ("config", CONFIG_PATTERNS),
    ("frontend", FRONTEND_PATTERNS),
    ("backend", BACKEND_PATTERNS),
]
MIXED_BELOW = 0.6

#: Named path patterns (fixed values).
NAMED_PATTERNS: list[tuple[str, str]] = [
    ("grid-table-files", r"(grid|kendo|table|columns)"),
    ("angular-component-files", r"\.component\.(ts|html|css|scss|sass|less)$"),
    ("service-files", r"\.service\.ts$"),
    ("unit-test-files", r"\.spec\.ts$|\.test\.[jt]sx?$"),
    ("e2e-test-files", r"(^|/)(playwright|e2e|cypress)(/|$)"),
    ("configuration-files", r"(environment|config|\.env|\.json|\.ya?ml)"),
    ("api-endpoint-files", r"(^|/)(api|routes|controllers|endpoint|server)(/|$)"),
    ("documentation-files", r"(^|/)(docs|readme|changelog|contributing)(/|\.|$)"),
]

# -- file roles (fixed values) ----------------------------------------------------

GENERATED_PATTERNS = [
    r"(^|/)docs/progress(/|$)",
    r"(^|/)docs/testfiles\.html$",
    r"(^|/)docs/test-progress\.svg$",
    r"(^|/)data/test-files\.csv$",
    r"(^|/)logs?(/|$)",
    r"(^|/)test-results\.md$",
    r"(^|/)plan\.md$",
    r"(^|/)(coverage|dist|build|generated|reports?|snapshots?|baselines?|replay|fixtures?)(/|$)",
]
NOISY_EVIDENCE_PATTERNS = [
    r"(^|/)docs/progress(/|$)",
    r"(^|/)docs/testfiles\.html$",
    r"(^|/)docs/test-progress\.svg$",
    r"(^|/)data/test-files\.csv$",
    r"(^|/)logs?(/|$)",
    r"(^|/)test-results\.md$",
    r"(^|/)plan\.md$",
    r"(^|/)(fixtures?|reports?|replay|baselines?|snapshots?|coverage|dist|build|generated)(/|$)",
    r"(^|/)package-lock\.json$",
    r"(^|/)repo_learning_state\.json$",
    r"\.expected\.json$",
    r"\.report\.json$",
]
NOISY_ROLES = ["generated", "fixture", "build-output", "lockfile"]
SOURCE_EXTENSIONS = [".ts", ".tsx", ".js", ".jsx", ".py", ".java", ".kt", ".cs", ".go", ".rs", ".rb", ".php", ".swift", ".sql"]
CONFIG_FILE_NAMES = [
    "package.json",
    "tsconfig.json",
    "jsconfig.json",
    "vite.config.ts",
    "vite.config.js",
    "webpack.config.js",
    "webpack.config.ts",
    "eslint.config.js",
    "eslint.config.mjs",
    "jest.config.js",
    "jest.config.ts",
    "playwright.config.ts",
    "angular.json",
    "nx.json",
    "pyproject.toml",
    "pytest.ini",
    "tox.ini",
    "setup.cfg",
    "go.mod",
    "cargo.toml",
    "pom.xml",
    "build.gradle",
    "build.gradle.kts",
    "makefile",
    "dockerfile",
]


def _ends_in(names: list[str]) -> str:
    return "(^|/)(" + "|".join(n.replace(".", r"\.") for n in names) + ")$"


def _has_extension(extensions: list[str]) -> str:
    return "[^/.][^/]*(" + "|".join(e.replace(".", r"\.") for e in extensions) + ")$"


#: Roles in order; the first match decides, else "unknown" (fixed values).
ROLES: list[tuple[str, str]] = [
    ("lockfile", r"(^|/)(package-lock\.json|pnpm-lock\.yaml|yarn\.lock|gemfile\.lock|cargo\.lock|go\.sum|poetry\.lock)$"),
    ("build-output", r"(^|/)(dist|build|coverage|out|target)(/|$)"),
    ("generated", "|".join(GENERATED_PATTERNS)),
    ("fixture", r"(^|/)(fixtures?|snapshots?|baselines?|replay)(/|$)|\.(expected|snapshot)\.json$"),
    ("generated", r"(^|/)(generated|reports?)(/|$)|\.report\.json$|repo_learning_state\.json$"),
    ("test", r"(\.spec\.|\.(test|tests)\.|_(test|spec)\.)|(^|/)(__tests__|tests?|specs?|e2e|playwright|cypress)(/|$)"),
    ("docs", r"(^|/)(docs?|documentation)(/|$)|(^|/)(readme|changelog|contributing|license)(\.|$)|\.(md|mdx|rst|adoc|txt)$"),
    ("config", _ends_in(CONFIG_FILE_NAMES) + r"|\.(ya?ml|toml|ini|json|env)$|(^|/)(config|configs|\.github/workflows)(/|$)"),
    ("source", _has_extension(SOURCE_EXTENSIONS)),
]
ROLE_NAMES = ["source", "test", "config", "docs", "generated", "lockfile", "fixture", "build-output", "unknown"]
CO_CHANGE_ROLES = ["source", "test", "config", "docs"]

# -- path signals: (gate or None, [(pattern, signals)]) (fixed values) ------------

TYPESCRIPT_SIGNALS: list[tuple[str, list[str]]] = [
    (r"\.(tsx|jsx|html|css|scss|sass|less|vue|svelte)$|(^|/)(ui|web|client|frontend|components|pages|screens|views)(/|$)", ["ui_changed"]),
    (r"(^|/)(components?|widgets?)(/|$)|\.component\.(ts|tsx|html|css|scss)$|component\.(ts|tsx)$", ["component_changed"]),
    (r"(^|/)(pages?|screens?|views?)(/|$)", ["page_or_screen_changed"]),
    (r"(^|/)(routes?|router|routing)(/|$)|routes?\.(ts|tsx|js|jsx)$", ["route_view_changed"]),
    (r"\.(css|scss|sass|less)$", ["style_changed"]),
    (r"(^|/)(api|server|backend|controllers?|routes?|middleware|services?)(/|$)|\.(controller|resolver|route|middleware|service)\.[jt]s$", ["backend_changed"]),
    (r"(^|/)(controllers?)(/|$)|\.controller\.[jt]s$", ["controller_changed"]),
    (r"(^|/)(services?)(/|$)|\.service\.[jt]s$", ["service_layer_changed"]),
    (r"(^|/)(repositories?|dao|daos)(/|$)|\.(repository|repo|dao)\.[jt]s$", ["repository_or_dao_changed"]),
    (r"(^|/)middleware(/|$)|\.middleware\.[jt]s$", ["middleware_changed"]),
    (r"(^|/)(auth|authentication|authorization)(/|$)|auth\.[jt]s$", ["auth_changed"]),
    (r"(^|/)(validators?|validation|schemas?)(/|$)|\.(validator|schema|zod)\.[jt]s$", ["validation_changed"]),
    (r"(^|/)(serializers?|dto|dtos|mappers?)(/|$)|\.(serializer|dto|mapper)\.[jt]s$", ["serialization_changed"]),
    (r"(^|/)(jobs?|workers?|tasks?)(/|$)|\.(job|worker|task)\.[jt]s$", ["background_job_changed"]),
    (r"(^|/)(queues?|events?|handlers?|consumers?|subscribers?)(/|$)|\.(handler|consumer|subscriber|event)\.[jt]s$", ["queue_or_event_handler_changed"]),
    (r"(^|/)(models?|entities?)(/|$)|\.(model|entity)\.[jt]s$|schema\.prisma$", ["model_or_entity_changed", "db_changed"]),
]
PYTHON_GATE = r"\.py$"
PYTHON_SIGNALS: list[tuple[str, list[str]]] = [
    (r"(^|/)(api|views|routes|routers|controllers|middleware|services)(/|$)", ["backend_changed"]),
    (r"(^|/)(views|routes|routers)(/|$)", ["api_route_changed"]),
    (r"(^|/)(services?)(/|$)|service\.py$", ["service_layer_changed"]),
    (r"(^|/)(repositories?|dao|daos)(/|$)|repository\.py$|dao\.py$", ["repository_or_dao_changed"]),
    (r"(^|/)(middleware)(/|$)", ["middleware_changed"]),
    (r"(^|/)(auth|authentication|authorization)(/|$)", ["auth_changed"]),
    (r"(^|/)(validators?|validation|schemas?|serializers?)(/|$)", ["validation_changed"]),
    (r"(^|/)(serializers?|schemas?)(/|$)", ["serialization_changed"]),
    (r"(^|/)(models?|entities?)(/|$)|models\.py$", ["db_changed", "model_or_entity_changed"]),
    (r"(^|/)(jobs?|workers?|tasks?)(/|$)", ["background_job_changed"]),
    (r"(^|/)(queues?|events?|handlers?|consumers?)(/|$)", ["queue_or_event_handler_changed"]),
]
JVM_GATE = r"\.(java|kt|kts)$"
JVM_SIGNALS: list[tuple[str, list[str]]] = [
    (r"(controller|resource|endpoint)", ["backend_changed", "controller_changed"]),
    (r"service", ["service_layer_changed"]),
    (r"(repository|dao)", ["repository_or_dao_changed"]),
    (r"(middleware|filter|interceptor)", ["middleware_changed"]),
    (r"(auth|security)", ["auth_changed"]),
    (r"(validator|validation)", ["validation_changed"]),
    (r"(serializer|mapper|dto)", ["serialization_changed"]),
    (r"(entity|model)", ["db_changed", "model_or_entity_changed"]),
    (r"(job|worker|task|scheduler)", ["background_job_changed"]),
    (r"(event|handler|listener|consumer|subscriber)", ["queue_or_event_handler_changed"]),
    (r"(controller|resource|endpoint|service|repository|dao|middleware|filter|interceptor|auth|security|validator|validation|serializer|mapper|dto|entity|model|job|worker|task|scheduler|event|handler|listener|consumer|subscriber)", ["backend_changed"]),
]
DOTNET_GATE = r"\.(cs|csproj|sln)$"
DOTNET_SIGNALS: list[tuple[str, list[str]]] = [
    (r"(controller|endpoint)", ["backend_changed", "controller_changed"]),
    (r"service", ["service_layer_changed"]),
    (r"(repository|dao)", ["repository_or_dao_changed"]),
    (r"(middleware|filter)", ["middleware_changed"]),
    (r"(auth|identity|security)", ["auth_changed"]),
    (r"(validator|validation)", ["validation_changed"]),
    (r"(serializer|mapper|dto)", ["serialization_changed"]),
    (r"(entity|model)", ["db_changed", "model_or_entity_changed"]),
    (r"(job|worker|task|backgroundservice)", ["background_job_changed"]),
    (r"(event|handler|consumer|subscriber)", ["queue_or_event_handler_changed"]),
    (r"\.(csproj|sln)$", ["config_changed"]),
]
SQL_SIGNALS: list[tuple[str, list[str]]] = [
    (r"(^|/)(migrations?|db/migrate|alembic|flyway|liquibase|prisma/migrations|knex|schema)(/|$)|\.(sql|prisma)$", ["db_changed"]),
    (r"(^|/)(migrations?|db/migrate|alembic|flyway|liquibase|prisma/migrations|knex)(/|$)", ["migration_changed"]),
    (r"schema\.prisma$|schema\.sql$|(^|/)schema(/|$)", ["schema_changed"]),
    (r"(^|/)(models?|entities?)(/|$)|\.(model|entity)\.", ["model_or_entity_changed"]),
    (r"(^|/)(seeds?|fixtures?/seeds?)(/|$)|seed\.(sql|ts|js|py)$", ["seed_data_changed"]),
    (r"(^|/)(queries?|sql)(/|$)|query\.(sql|ts|js|py)$", ["query_changed"]),
]
INFRA_SIGNALS: list[tuple[str, list[str]]] = [
    (r"(^|/)\.env|environment|config|settings|\.ya?ml$|\.json$|\.toml$|\.ini$", ["config_changed"]),
    (r"(^|/)\.env|env\.", ["env_changed"]),
    (r"(^|/)(package\.json|package-lock\.json|pnpm-lock\.yaml|yarn\.lock|requirements\.txt|pyproject\.toml|poetry\.lock|pom\.xml|build\.gradle|go\.mod|cargo\.toml|\.csproj)$", ["package_or_dependency_changed", "config_changed"]),
    (r"(^|/)(\.github/workflows|\.gitlab-ci\.yml|jenkinsfile|circle\.yml|azure-pipelines\.yml)(/|$|\.yml)", ["ci_changed", "config_changed"]),
    (r"(^|/)(dockerfile|docker-compose\.ya?ml)$|(^|/).*\.dockerfile$", ["docker_changed", "deployment_changed"]),
    (r"\.(tf|tfvars)$|(^|/)(terraform|infra|infrastructure)(/|$)", ["terraform_or_infra_changed", "deployment_changed"]),
    (r"(^|/)(k8s|kubernetes|helm|deploy|deployment|manifests)(/|$)", ["deployment_changed"]),
]
TEST_DOCS_SIGNALS: list[tuple[str, list[str]]] = [
    (r"(\.spec\.|\.(test|tests)\.)|(^|/)__tests__(/|$)|(^|/)tests?(/|$)", ["unit_test_changed"]),
    (r"(^|/)(integration|integ)(/|$)|integration\.(spec|test)\.", ["integration_test_changed"]),
    (r"(^|/)(e2e|playwright|cypress)(/|$)|playwright\.config|cypress\.config", ["e2e_test_changed"]),
    (r"(^|/)(contracts?|pact)(/|$)|contract\.(spec|test)\.", ["contract_test_changed"]),
    (r"(^|/)(fixtures?|testdata|test-data|__fixtures__)(/|$)", ["fixture_changed"]),
]
#: Both must match for "frontend_test_changed", which comes between the two lists.
FRONTEND_TEST = (r"(^|/)(ui|web|client|frontend)(/|.*tests?/)", r"(\.spec\.|\.(test|tests)\.)")
DOCS_SIGNALS: list[tuple[str, list[str]]] = [
    (r"(^|/)(docs?|documentation)(/|$)|\.(md|mdx|rst|adoc)$", ["docs_changed"]),
    (r"(^|/)readme(\.|$)", ["readme_changed"]),
    (r"(^|/)(adr|adrs|architecture|design-docs?)(/|$)", ["adr_or_design_doc_changed"]),
    (r"(^|/)changelog(\.|$)|(^|/)changes(/|$)", ["changelog_changed"]),
]

#: Framework hints in detector order (fixed values).
FRAMEWORK_HINTS: list[tuple[str, list[str]]] = [
    (r"schema\.prisma$", ["prisma"]),
    (r"nest|\.controller\.ts$|\.module\.ts$", ["nestjs"]),
    (r"angular\.json$|\.component\.ts$", ["angular"]),
    (r"\.(tsx|jsx)$", ["react-like"]),
    (r"next\.config|(^|/)app/.*page\.(tsx|jsx|ts|js)$", ["nextjs"]),
    (r"(^|/)manage\.py$|(^|/)settings\.py$|models\.py$|views\.py$", ["django"]),
    (r"(^|/)(routers?|api)(/|$)", ["fastapi-or-flask"]),
    (r"(^|/)alembic(/|$)", ["alembic"]),
    (r"(controller|repository|entity|service).*\.(java|kt)$", ["spring-or-jvm"]),
    (r"build\.gradle|\.gradle\.kts$", ["gradle"]),
    (r"pom\.xml$", ["maven"]),
    (r"\.(cs|csproj|sln)$", ["dotnet"]),
    (r"schema\.prisma$|prisma/migrations", ["prisma"]),
    (r"alembic", ["alembic"]),
    (r"flyway", ["flyway"]),
    (r"liquibase", ["liquibase"]),
    (r"knex", ["knex"]),
    (r"db/migrate", ["rails-like-migrations"]),
    (r"docker", ["docker"]),
    (r"\.github/workflows", ["github-actions"]),
    (r"jenkinsfile", ["jenkins"]),
    (r"\.gitlab-ci", ["gitlab-ci"]),
    (r"\.(tf|tfvars)$", ["terraform"]),
    (r"(k8s|kubernetes|helm)", ["kubernetes-or-helm"]),
]

#: Signals that a diff signal's lower-cased value adds (fixed values).
VALUE_SIGNALS: list[tuple[str, list[str]]] = [
    (r"(controller|resource|endpoint)", ["controller_changed"]),
    (r"service", ["service_layer_changed"]),
    (r"(repository|dao)", ["repository_or_dao_changed"]),
    (r"(middleware|filter|interceptor)", ["middleware_changed"]),
    (r"(auth|permission|identity|security)", ["auth_changed"]),
    (r"(validat|schema)", ["validation_changed"]),
    (r"(serializer|serialize|mapper|dto)", ["serialization_changed"]),
    (r"(job|worker|task|schedule)", ["background_job_changed"]),
    (r"(queue|event|handler|consumer|subscriber|listener)", ["queue_or_event_handler_changed"]),
]
MODEL_VALUE, MODEL_PATH = r"(model|entity)", r"(^|/)(models?|entities?)(/|$)"

#: Order of signals in a commit's shape; others follow by name (fixed values).
SIGNAL_PRIORITY = [
    "api_route_changed",
    "controller_changed",
    "service_layer_changed",
    "repository_or_dao_changed",
    "migration_changed",
    "schema_changed",
    "model_or_entity_changed",
    "query_changed",
    "queue_or_event_handler_changed",
    "background_job_changed",
    "component_changed",
    "page_or_screen_changed",
    "frontend_test_changed",
    "integration_test_changed",
    "e2e_test_changed",
    "unit_test_changed",
    "test_case_added",
    "ci_changed",
    "docker_changed",
    "terraform_or_infra_changed",
    "deployment_changed",
    "config_changed",
    "package_or_dependency_changed",
    "docs_changed",
    "cli_command_changed",
    "function_added",
    "class_added",
    "interface_or_type_added",
]
CODE_ONLY_SIGNALS = ["exported_symbol_added", "function_added", "class_added", "interface_or_type_added", "enum_added"]

#: Broad areas of signals for drift; a signal may be in several (fixed values).
BROAD_AREAS: list[tuple[str, list[str]]] = [
    (r"^(ui|component|page_or_screen|route_view|style|frontend)", ["frontend"]),
    (r"^(backend|api_route|controller|service_layer|repository_or_dao|middleware|auth|validation|serialization|background_job|queue_or_event)", ["backend"]),
    (r"^(db|migration|schema|model_or_entity|seed_data|query|index)", ["database"]),
    (r"^(config|env|package_or_dependency|ci|docker|terraform_or_infra|deployment)", ["config"]),
    (r"(test|fixture)", ["tests"]),
    (r"^(docs|readme|adr_or_design_doc|changelog)", ["docs"]),
    (r"^cli_command", ["cli"]),
]

# -- words (fixed values) ---------------------------------------------------------

STOP_TERMS = [
    "add", "added", "adds", "update", "updated", "updates", "fix", "fixed", "improve", "improved", "refactor", "change",
    "changes", "support", "with", "from", "into", "the", "and", "for", "use", "using",
]
TERM_NOISE = [
    "add", "added", "update", "updated", "fix", "fixed", "improve", "improved", "refactor", "change", "changes", "file",
    "files", "src", "source", "test", "tests", "spec", "index", "main", "lib", "core", "common", "shared", "generated",
    "fixture", "fixtures", "report", "reports", "expected", "snapshot", "snapshots",
]
CONCEPT_TERMS = [
    "grid", "table", "columns", "column", "paging", "pagination", "sorting", "sort", "filter", "search", "export",
    "controller", "route", "router", "handler", "rest", "api", "service", "repository", "command", "commands", "cli",
    "option", "flag", "migration", "schema", "model", "entity", "query", "validation", "fixture", "component", "page",
    "screen",
]
CONCEPT_SYNONYMS = {
    "column": "columns", "sort": "sorting", "sortable": "sorting", "paginate": "pagination", "commands": "command",
    "controllers": "controller", "routes": "route", "models": "model", "entities": "entity",
}
COMMON_TAGS = [
    "div", "span", "button", "input", "form", "label", "table", "thead", "tbody", "tr", "td", "th", "section", "article",
    "header", "footer", "main", "nav", "p", "a", "ul", "li",
]
ENTITY_WORDS = ["user", "profile", "account", "customer", "order"]

# -- thresholds (fixed values) ----------------------------------------------------

CO_CHANGE_MIN_WEIGHT, CO_CHANGE_KEPT, FREQUENT_KEPT = 2, 50, 50
SURFACE_MIN_COMMITS, SURFACE_MIN_CONFIDENCE, SURFACES_KEPT = 2, 0.35, 25
CLUSTER_JOIN, CLUSTER_SURFACE_BONUS, CLUSTER_DIRECTORY_BONUS, CLUSTER_MERGE = 0.46, 0.45, 0.15, 0.7
FAMILY_JOIN, FAMILY_MIN_CONFIDENCE, FAMILIES_KEPT = 0.5, 0.55, 50
SUPPORT_SIGNALS, SUPPORT_DIRECTORIES, SUPPORT_TERMS = 0.35, 0.25, 0.25
DRIFT_SIGNALS, DRIFT_OTHERS, DRIFT_MIN_COMMITS, STALE_COMMITS = 0.28, 0.2, 2, 10
#: Shares of F10, by feature list.
SIMILARITY_WEIGHTS: list[tuple[str, str, float]] = [
    ("framework", "frameworks", 0.20),
    ("library", "libraries", 0.20),
    ("component tag", "component_tags", 0.16),
    ("role", "roles", 0.14),
    ("concept", "concepts", 0.14),
    ("symbol pattern", "symbol_patterns", 0.08),
    ("route", "route_patterns", 0.08),
    ("cli option", "cli_options", 0.08),
    ("schema/model", "schema_models", 0.08),
    ("test", "test_patterns", 0.04),
]
