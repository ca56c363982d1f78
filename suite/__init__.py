"""Registered queries and the SQL each of them is checked against."""


def modules():
    from suite import catalog, documents, registry, results, vectors, workorders

    return [workorders, documents, catalog, registry, vectors, results]
