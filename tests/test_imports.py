"""Imports resolved by path."""

import pytest

from corpusaudit.operators import imports

FILES = [
    ("r", "shop/utils.py", ""),
    ("r", "shop/cart.py", "from utils import total\nfrom . import models\nimport os"),
    ("r", "shop/models/__init__.py", "from .item import Item"),
    ("r", "shop/models/item.py", "from ..utils import x\nfrom shop.cart import Cart"),
    ("r", "blog/utils.py", "import blog.utils"),
    ("r", "blog/post.py", "import utils\n  from shop import cart, utils as u"),
    ("r", "blog/deep/er/page.py", "from utils import y\nfrom ....far import z"),
    ("r", "main.py", "import shop.models.item, blog\nfrom blog.post import (a,\n b)\nimport item"),
    ("r", "web/app.ts", "import { a } from './lib/view';\nimport React from 'react';\nexport * from './lib'"),
    ("r", "web/lib/index.ts", "import '../app.js'\nconst x = require('./view')"),
    ("r", "web/lib/view.tsx", "import y from '../../web/lib/index'"),
    ("r", "web/utils.js", None),
    ("r", "notes.txt", "import utils"),
    ("s", "shop/cart.py", "import utils"),
    ("s", "utils.py", None),
]
EDGES = [
    ("r", "blog/deep/er/page.py", "blog/utils.py"),
    ("r", "blog/post.py", "blog/utils.py"),
    ("r", "blog/post.py", "shop/cart.py"),
    ("r", "blog/post.py", "shop/utils.py"),
    ("r", "main.py", "blog/post.py"),
    ("r", "main.py", "shop/models/item.py"),
    ("r", "shop/cart.py", "shop/models/__init__.py"),
    ("r", "shop/cart.py", "shop/utils.py"),
    ("r", "shop/models/__init__.py", "shop/models/item.py"),
    ("r", "shop/models/item.py", "shop/cart.py"),
    ("r", "shop/models/item.py", "shop/utils.py"),
    ("r", "web/app.ts", "web/lib/index.ts"),
    ("r", "web/app.ts", "web/lib/view.tsx"),
    ("r", "web/lib/index.ts", "web/app.ts"),
    ("r", "web/lib/index.ts", "web/lib/view.tsx"),
    ("r", "web/lib/view.tsx", "web/lib/index.ts"),
    ("s", "shop/cart.py", "utils.py"),
]


@pytest.fixture(scope="module")
def files(spark):
    return spark.createDataFrame(FILES, "repo string, file_path string, source_code string")


def test_imports_mean_one_file(files, rows):
    assert rows(imports.resolved_imports(files)) == EDGES


def test_degrees(files):
    found = {(r["repo"], r["file_path"]): (r["depends_on"], r["depended_on_by"]) for r in imports.resolved_degrees(files).collect()}
    assert len(found) == len(FILES)
    assert found["r", "shop/utils.py"] == (0, 3) and found["r", "blog/utils.py"] == (0, 2)
    assert found["s", "utils.py"] == (0, 1) and found["r", "web/utils.js"] == found["r", "notes.txt"] == (0, 0)


def test_shared_names_make_no_pairs(spark):
    """Every importer finds its own package's file, and rows grow with files, not with pairs."""
    df = spark.range(400).selectExpr("concat('p', id, '/utils.py') AS file_path", "'' AS source_code").union(
        spark.range(400).selectExpr("concat('p', id, '/use.py') AS file_path", "'import utils' AS source_code")
    )
    edges = imports.resolved_imports(df)
    assert edges.count() == 400 and edges.where("substring_index(file_path, '/', 1) <> substring_index(target, '/', 1)").isEmpty()
    assert imports.resolved_imports(df.limit(0)).isEmpty()
