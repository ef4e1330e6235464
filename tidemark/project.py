"""Projects in folders.

    setup.py                        catalogs() -> {name: root}; optional: extensions(spark),
                                    secrets(spark), sources(), sinks(), effectors()
    catalogs/<catalog>/<view>.sql           a view in schema main
    catalogs/<catalog>/<schema>/<view>.sql  a view in another schema
"""

from __future__ import annotations

import importlib.util
from pathlib import Path

from pyspark.sql import SparkSession

from .orchestrator import Orchestrator, OrchestratorError


class ProjectError(OrchestratorError):
    """A folder that is not a project."""


class MissingSetupError(ProjectError): ...


class InvalidSetupError(ProjectError): ...


class MissingCatalogsError(ProjectError): ...


class MVCompilationError(ProjectError):
    def __init__(self, catalog: str, schema: str, mv_name: str, cause: Exception):
        super().__init__(f"{catalog}.{schema}.{mv_name}: {cause}")
        self.catalog, self.schema, self.mv_name, self.cause = catalog, schema, mv_name, cause


def load_directory(spark: SparkSession, folder: str | Path, errors: list[ProjectError] | None = None, compile_views: bool = True) -> Orchestrator:
    """An orchestrator with all that a project names; errors of single views go to `errors` if it is given."""
    folder = Path(folder)
    setup = folder / "setup.py"
    if not setup.exists():
        raise MissingSetupError(str(setup))
    spec = importlib.util.spec_from_file_location(f"project_{abs(hash(str(folder.resolve())))}", setup)
    module = importlib.util.module_from_spec(spec)
    try:
        spec.loader.exec_module(module)
    except Exception as e:
        raise InvalidSetupError(f"{setup}: {e}") from e
    if not callable(getattr(module, "catalogs", None)):
        raise InvalidSetupError(f"{setup} has no catalogs()")
    made = Orchestrator(spark)
    if hasattr(module, "extensions"):
        made.setup_extensions(module.extensions)
    if hasattr(module, "secrets"):
        made.setup_secrets(module.secrets)
    for name, root in module.catalogs().items():
        made.add_catalog(name, root)
    for kind in ("source", "sink", "effector"):
        for x in getattr(module, f"{kind}s", list)():
            getattr(made, f"add_{kind}")(x)
    views = folder / "catalogs"
    if not views.is_dir():
        raise MissingCatalogsError(str(views))
    for file in sorted(views.glob("*/*.sql")) + sorted(views.glob("*/*/*.sql")):
        parts = file.relative_to(views).parts
        made.add_ivm(parts[0], file.stem, file.read_text(encoding="utf-8").strip().rstrip(";"), schema=parts[1] if len(parts) == 3 else "main")
    if compile_views and not made.sources:
        for level in made.levels():
            for key in level:
                if any(not made._exists(k) for k in made._reads(key)):
                    continue  # it reads a view that has not been created yet
                try:
                    made._compile(key)
                except Exception as e:
                    s = made.specs[key]
                    error = MVCompilationError(s["mv_catalog"], s["mv_schema"], s["name"], e)
                    if errors is None:
                        raise error from e
                    errors.append(error)
    return made
