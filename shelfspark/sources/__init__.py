from shelfspark.sources.raw import RawTables
from shelfspark.sources import schemas

__all__ = ["RawTables", "schemas"]
