"""tessera: prompt-chain, document-library and conversation-memory workloads on Spark.

The public operators, by area (see README.md for the full map):

* ``tessera.functions.text``      scalar text functions (tokens, gates, JSON/URL checks, hashing, cuts)
* ``tessera.functions.template``  step templates compiled to native ``concat``
* ``tessera.functions.guided``    JSON schema -> regex checks and typed parsing
* ``tessera.operators.library``   chunking, ingest by content hash, embedding, exact top-k search
* ``tessera.operators.memory``    conversation turns, history, sliding memory, session operations
* ``tessera.operators.results``   keyed result store
* ``tessera.operators.pages``     page main text, first good page, BM25 page search
* ``tessera.operators.ask``       table questions as Spark SQL statements, reports, recipes
* ``tessera.operators.complete``  batch completion around a user-supplied model
* ``tessera.plans.chain``         step tables run over prompt tables as one lazy plan
* ``tessera.sources.tables``      delimited tables, step tables, text documents, stores
* ``tessera.streaming.streams``   Structured Streaming ingest, memory and chains
"""

from tessera.session import checkpoint_root, get_spark, register_tables, scratch_path

__all__ = ["checkpoint_root", "get_spark", "register_tables", "scratch_path"]
__version__ = "0.1.0"
