"""Complete jobs and the registered queries, composed from sources and operators."""
