"""Texts of the derived source files, and what each of them declares.

``{k}`` stands for the part key and ``{alias}`` for another file's stem.  The
expectations are written by hand from the texts; the check SQL uses only them.

    symbols  (stage, pos, parent, name, type)
    imports  (stage, pos, raw, kind)

``more`` is appended to the text of every third file, with its own symbols.
"""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Template:
    ext: str
    text: str
    symbols: list = field(default_factory=list)
    imports: list = field(default_factory=list)
    more: str = ""
    more_symbols: list = field(default_factory=list)
    rule_symbols: list = field(default_factory=list)  # pattern-only JavaScript
    rule_imports: list = field(default_factory=list)


PAD = "// ................................................\n" * 42
INNER_PAD = "  // ..............................................\n" * 28

PY = Template(
    ".py",
    """import os
from .pkg import thing{k}

class Plain{k}:
    def run{k}(self):
        def inner{k}():
            return 1
        return inner{k}

class Conf{k}(BaseModel):
    pass

class Mod{k}(models.Model):
    pass

async def load{k}(x):
    return x

@task
def job{k}():
    pass

def my_Task{k}(): pass

@app.get
def bare{k}(): pass

@app.get("/x")
def called{k}(): pass

def test_it{k}(): pass

def _hidden{k}(): pass
""",
    symbols=[
        (0, 0, None, "Plain{k}", "class"),
        (0, 1, None, "run{k}", "function"),
        (0, 2, None, "inner{k}", "function"),
        (0, 3, None, "Conf{k}", "pydantic_model"),
        (0, 4, None, "Mod{k}", "class"),
        (0, 5, None, "load{k}", "async_function"),
        (0, 6, None, "job{k}", "celery_task"),
        (0, 7, None, "my_Task{k}", "celery_task"),
        (0, 8, None, "bare{k}", "fastapi_endpoint"),
        (0, 9, None, "called{k}", "function"),
        (0, 10, None, "test_it{k}", "test"),
        (0, 11, None, "_hidden{k}", "function"),
    ],
    more="""
class Extra{k}(BaseSettings):
    async def run{k}(self): pass
    def log(self): pass
""",
    more_symbols=[
        (0, 12, None, "Extra{k}", "pydantic_model"),
        (0, 13, None, "run{k}", "async_function"),
        (0, 14, None, "log", "function"),
    ],
)

PYBAD = Template(
    ".py",
    """class Broken{k}(object):
    def go{k}(self)
        pass
class lower{k}: pass
def taskrun{k}(): pass
def _priv{k}(): pass
print "subclass Word{k}"
""",
    symbols=[
        (0, 0, None, "Broken{k}", "class"),
        (0, 1, None, "Word{k}", "class"),
        (1, 0, None, "go{k}", "function"),
        (1, 1, None, "taskrun{k}", "celery_task"),
    ],
)

JS = Template(
    ".js",
    """const fs = require('fs');
const lazy{k} = import('./lazy{k}');
import helper from './helper';
import gone from '../nowhere/x{k}';
import { q } from 'react-dom/client';
class Plain{k} {
  go{k}(a, b) {
    return a + b;
  }
  static make{k}() {
    return new Plain{k}();
  }
}
function plainFn{k}(a) {
  for (const x of a) {
    if (x) {
      call(x);
    }
  }
}
export default function Main{k}() {
  return 1;
}
let arrow{k} = x => x;
var old{k} = 5;
class Tight{k} { foo{k}() {} bar{k}() {} }
const p{k} = () => 1, q{k} = () => 2;
const deep{k} = (a = g(h(1))) => a;
if (p{k}) { function inIf{k}() {} }
describe('x', () => { const inCall{k} = () => 1; });
/* function ghost{k}() {} */
class Svc{k} {
  one{k}(a = f(g(1)), b = {x: 1}) {
    return {inner{k}(c) { return c; }};
  }
}
""",
    symbols=[
        (0, 0, None, "Plain{k}", "class"),
        (0, 1, "Plain{k}", "go{k}", "method"),
        (0, 2, "Plain{k}", "make{k}", "method"),
        (0, 3, None, "plainFn{k}", "function"),
        (0, 4, None, "Main{k}", "function"),
        (0, 5, None, "arrow{k}", "function"),
        (0, 6, None, "Tight{k}", "class"),
        (0, 7, "Tight{k}", "foo{k}", "method"),
        (0, 8, "Tight{k}", "bar{k}", "method"),
        (0, 9, None, "p{k}", "function"),
        (0, 10, None, "q{k}", "function"),
        (0, 11, None, "deep{k}", "function"),
        (0, 12, None, "inIf{k}", "function"),
        (0, 13, None, "inCall{k}", "function"),
        (0, 14, None, "Svc{k}", "class"),
        (0, 15, "Svc{k}", "one{k}", "method"),
    ],
    imports=[
        (1, 0, "./helper", "js"),
        (1, 1, "../nowhere/x{k}", "js"),
        (1, 2, "react-dom/client", "js"),
    ],
    rule_symbols=[
        (3, 0, None, "Plain{k}", "class"),
        (3, 1, None, "Tight{k}", "class"),
        (3, 2, None, "Svc{k}", "class"),
        (4, 0, None, "plainFn{k}", "function"),
        (4, 1, None, "Main{k}", "function"),
        (4, 2, None, "inIf{k}", "function"),
        (4, 3, None, "ghost{k}", "function"),
        (4, 4, None, "fs", "function"),
        (4, 5, None, "lazy{k}", "function"),
        (4, 6, None, "arrow{k}", "function"),
        (4, 7, None, "old{k}", "function"),
        (4, 8, None, "p{k}", "function"),
        (4, 9, None, "deep{k}", "function"),
    ],
    rule_imports=[
        (5, 0, "{here}helper", "path"),
        (5, 1, "{up}nowhere/x{k}", "path"),
        (5, 2, "react-dom", "npm_package"),
        (5, 3, "{here}lazy{k}", "path"),
        (5, 4, "fs", "npm_package"),
    ],
)

JSX = Template(
    ".jsx",
    """import React from 'react';
import Thing from '@/{alias}';
export class View{k} extends React.Component {
  render() {
    return (<div>{k}</div>);
  }
}
function Card{k}(props) {
  return (
    <section/>
  );
}
const Row{k} = (props) => {
  return <tr/>;
};
function useData{k}() {
  return 1;
}
export const getStaticProps = async () => ({});
const helperVal = 3;
""",
    symbols=[
        (0, 0, None, "View{k}", "react_component"),
        (0, 1, "View{k}", "render", "method"),
        (0, 2, None, "Card{k}", "react_component"),
        (0, 3, None, "Row{k}", "function"),
        (0, 4, None, "useData{k}", "react_hook"),
        (0, 5, None, "getStaticProps", "nextjs_data_fn"),
    ],
    imports=[(1, 0, "react", "js"), (1, 1, "@/{alias}", "js")],
    rule_symbols=[
        (3, 0, None, "View{k}", "react_component"),
        (4, 0, None, "Card{k}", "react_component"),
        (4, 1, None, "useData{k}", "react_hook"),
        (4, 2, None, "Row{k}", "react_component"),
        (4, 3, None, "getStaticProps", "nextjs_data_fn"),
        (4, 4, None, "helperVal", "function"),
    ],
    rule_imports=[(5, 0, "react", "npm_package"), (5, 1, "@", "npm_package")],
)

TS = Template(
    ".ts",
    """import { A } from '@/{alias}';
import def{k}, { b } from './helper';
import * as path from 'node:path';
import lodashGet from 'lodash/get';
import scoped from '@scope/pkg/sub';
import nope from '../missing/thing{k}';
import type { T } from 'src/{alias}';
import './side.css';
import ver from 'pkg@1.2/x';
export interface Shape{k} {
  area(): number;
}
export type Alias{k} = string | number;
export enum Color{k} { Red, Green }
@Controller('items')
export class ItemCtl{k} {
  constructor(private readonly s: Svc) {
    super();
  }
  @Get(':id')
  findOne{k}(id: string): string {
    if (id) {
      return id;
    }
    return other(id);
  }
}
export function useThing{k}() {
  const inner = () => 1;
  return inner;
}
export const Box{k} = () => {
  return (<div/>);
};
export async function loadIt{k}() {
  return {};
}
function console() {
}
""",
    symbols=[
        (0, 0, None, "Shape{k}", "interface"),
        (0, 1, None, "Alias{k}", "type_alias"),
        (0, 2, None, "ItemCtl{k}", "nestjs_controller"),
        (0, 3, "ItemCtl{k}", "constructor", "nestjs_endpoint"),
        (0, 4, "ItemCtl{k}", "findOne{k}", "nestjs_endpoint"),
        (0, 5, None, "useThing{k}", "react_hook"),
        (0, 6, None, "Box{k}", "react_component"),
        (0, 7, None, "loadIt{k}", "function"),
    ],
    imports=[
        (1, 0, "@/{alias}", "js"),
        (1, 1, "./helper", "js"),
        (1, 2, "node:path", "js"),
        (1, 3, "lodash/get", "js"),
        (1, 4, "@scope/pkg/sub", "js"),
        (1, 5, "../missing/thing{k}", "js"),
        (1, 6, "src/{alias}", "js"),
        (1, 7, "./side.css", "js"),
        (1, 8, "pkg@1.2/x", "js"),
    ],
    rule_symbols=[
        (0, 0, None, "Shape{k}", "interface"),
        (1, 0, None, "Alias{k}", "type_alias"),
        (2, 0, None, "Color{k}", "enum"),
        (3, 0, None, "ItemCtl{k}", "nestjs_controller"),
        (4, 0, None, "useThing{k}", "react_hook"),
        (4, 1, None, "loadIt{k}", "function"),
        (4, 2, None, "Box{k}", "function"),
    ],
    rule_imports=[
        (5, 0, "@", "npm_package"),
        (5, 1, "node:path", "npm_package"),
        (5, 2, "lodash", "npm_package"),
        (5, 3, "@scope", "npm_package"),
        (5, 4, "{up}missing/thing{k}", "path"),
        (5, 5, "src", "npm_package"),
        (5, 6, "pkg@1.2", "npm_package"),
    ],
)

TSX = Template(
    ".tsx",
    """@Injectable()
export class First{k} {
  list{k}() {
    return 1;
  }
}
class Second{k} {
}
"""
    + PAD
    + """class Third{k} {
  @Query()
  ask{k}(a: string) {
    return a;
  }
"""
    + INNER_PAD
    + """  far{k}() {
    return 2;
  }
}
export const Widget{k} = (props: P): JSX.Element => {
  return (<b/>);
};
""",
    symbols=[
        (0, 0, None, "First{k}", "nestjs_injectable"),
        (0, 1, "First{k}", "list{k}", "method"),
        (0, 2, None, "Second{k}", "nestjs_injectable"),
        (0, 3, None, "Third{k}", "class"),
        (0, 4, "Third{k}", "ask{k}", "nestjs_endpoint"),
        (0, 5, "Third{k}", "far{k}", "method"),
        (0, 6, None, "Widget{k}", "react_component"),
    ],
    rule_symbols=[
        (3, 0, None, "First{k}", "nestjs_service"),
        (3, 1, None, "Second{k}", "nestjs_service"),
        (3, 2, None, "Third{k}", "class"),
        (4, 0, None, "Widget{k}", "react_component"),
    ],
)

HELPER = Template(
    ".ts",
    "export function helper() {\n  return 1;\n}\n",
    symbols=[(0, 0, None, "helper", "function")],
    rule_symbols=[(4, 0, None, "helper", "function")],
)

GO = Template(
    ".go",
    """package main
import (
\t"fmt"
\t"github.com/acme/lib{k}"
\t"./local"
\t"trail/"
)
func Run{k}(a int) int {
\treturn a
}
func (s *Srv{k}) Serve{k}() {
\tfmt.Println("hello {k}")
}
type Srv{k} struct {
\tx int
}
type Doer{k} interface {
\tDo()
}
""",
    symbols=[
        (0, 0, None, "Run{k}", "function"),
        (0, 1, None, "Serve{k}", "function"),
        (1, 0, None, "Srv{k}", "struct"),
        (2, 0, None, "Doer{k}", "interface"),
    ],
    imports=[
        (3, 0, "fmt", "module"),
        (3, 1, "lib{k}", "module"),
        (3, 2, "hello {k}", "module"),
    ],
    more="func Extra{k}() {}\n",
    more_symbols=[(0, 2, None, "Extra{k}", "function")],
)

JAVA = Template(
    ".java",
    """package com.acme;
import java.util.List;
import org.lib{k}.Thing;
public class Main{k} {
    private int x = 0;
    public int run{k}(int a) {
        if (a > 0) {
            return helper{k}(a);
        }
        return 0;
    }
    interface Inner{k} { }
}
""",
    symbols=[
        (0, 0, None, "Main{k}", "class"),
        (0, 1, None, "Inner{k}", "class"),
        (1, 0, None, "run{k}", "method"),
    ],
    imports=[(2, 0, "java", "module"), (2, 1, "org", "module")],
)

KT = Template(
    ".kt",
    """import kotlin.math.max
data class Point{k}(val x: Int)
object Single{k} {
    fun calc{k}(a: Int): Int {
        return a
    }
    fun short{k}(b: Int) = b
    fun pick{k}() { when (b) { else -> 1 } }
}
""",
    symbols=[
        (0, 0, None, "Point{k}", "class"),
        (0, 1, None, "Single{k}", "class"),
        (1, 0, None, "calc{k}", "method"),
        (1, 1, None, "short{k}", "method"),
        (1, 2, None, "pick{k}", "method"),
    ],
    imports=[(2, 0, "kotlin", "module")],
)

CS = Template(
    ".cs",
    """using System.Text;
using Acme{k}.Core;
namespace Shop.App{k}
{
    public class Order{k}
    {
        public int Total{k}(int a)
        {
            foreach (var x in y) { }
            lock (this) { }
            return a;
        }
        public int Fast{k}(int b) => b;
    }
    record Item{k};
}
""",
    symbols=[
        (0, 0, None, "Order{k}", "class"),
        (0, 1, None, "Item{k}", "class"),
        (1, 0, None, "Total{k}", "method"),
        (1, 1, None, "foreach", "method"),
        (1, 2, None, "Fast{k}", "method"),
    ],
    imports=[(2, 0, "System", "namespace"), (2, 1, "Acme{k}", "namespace")],
    more="namespace Late{k}\n{\n}\n",
    more_symbols=[(3, 1, None, "Late{k}", "namespace")],
)
CS.symbols.append((3, 0, None, "Shop.App{k}", "namespace"))

CPP = Template(
    ".cpp",
    """#include <vector>
#include "local{k}.h"
namespace core{k} {
class Engine{k} {
 public:
  int start{k}(int a) const {
    if (a) { while (a) { a--; } }
    return a;
  }
};
struct Part{k} { int x; };
}
int main(int argc) {
  return 0;
}
""",
    symbols=[
        (0, 0, None, "Engine{k}", "class"),
        (0, 1, None, "Part{k}", "class"),
        (1, 0, None, "start{k}", "function"),
        (3, 0, None, "core{k}", "namespace"),
    ],
    imports=[(2, 0, "vector", "header"), (2, 1, "local{k}.h", "header")],
)

C = Template(
    ".c",
    """#include <stdio.h>
struct Node{k} { int v; };
static int walk{k}(struct Node{k} *n) {
  for (;;) { break; }
  return n->v;
}
""",
    symbols=[
        (0, 0, None, "Node{k}", "class"),
        (0, 1, None, "Node{k}", "class"),
        (1, 0, None, "walk{k}", "function"),
    ],
    imports=[(2, 0, "stdio.h", "header")],
)

DART = Template(
    ".dart",
    """import 'package:flutter/material.dart';
import "dart:io";
import 'src/local.dart';
class Home{k} extends StatelessWidget {
  void build() {
  }
}
class Plain{k} {
}
void main{k}(List args) {
}
Plain{k}(int z) {
}
""",
    symbols=[
        (0, 0, None, "Home{k}", "widget"),
        (1, 0, None, "Plain{k}", "class"),
        (2, 0, None, "main{k}", "function"),
    ],
    imports=[(3, 0, "flutter", "module"), (3, 1, "dart:io", "module")],
)

PROTO = Template(
    ".proto",
    """syntax = "proto3";
import "common/base{k}.proto";
service Svc{k} {
  rpc Call{k} (Req{k}) returns (Res{k});
}
message Req{k} {
}
message Res{k} {
}
""",
    symbols=[
        (0, 0, None, "Svc{k}", "service"),
        (1, 0, None, "Req{k}", "message"),
        (1, 1, None, "Res{k}", "message"),
        (2, 0, None, "Call{k}", "rpc"),
    ],
    imports=[(3, 0, "common/base{k}.proto", "proto")],
)

RB = Template(
    ".rb",
    """require 'json'
require "lib{k}/core"
module Mod{k}
  class Klass{k}
    include Comparable
    def self.make{k}
    end
    def run{k}(a)
    end
  end
end
""",
    symbols=[
        (0, 0, None, "Klass{k}", "class"),
        (1, 0, None, "Mod{k}", "module"),
        (2, 0, None, "make{k}", "method"),
        (2, 1, None, "run{k}", "method"),
    ],
    imports=[
        (3, 0, "json", "module"),
        (3, 1, "lib{k}/core", "module"),
        (4, 0, "Comparable", "includes"),
    ],
)

RS = Template(
    ".rs",
    """use std::io;
use crate::util{k};
use serde_{k}::{Serialize, Deserialize};
pub fn run{k}() {}
pub struct Point{k} { x: i32 }
enum Kind{k} { A, B }
pub trait Draw{k} { fn draw{k}(&self); }
impl Point{k} {
    pub fn area{k}(&self) -> i32 { 0 }
}
impl<T> Skip{k} for T {}
""",
    symbols=[
        (0, 0, None, "run{k}", "function"),
        (0, 1, None, "area{k}", "function"),
        (1, 0, None, "Point{k}", "struct"),
        (2, 0, None, "Kind{k}", "enum"),
        (3, 0, None, "Draw{k}", "trait"),
    ],
    imports=[
        (4, 0, "Point{k}", "implements"),
        (5, 0, "std", "module"),
        (5, 1, "serde_{k}", "module"),
    ],
)

SWIFT = Template(
    ".swift",
    """import Foundation
public class View{k} {
    func inner{k}() {}
}
protocol Doer{k} {}
func top{k}() {}
public func open{k}() {}
""",
    symbols=[
        (0, 0, None, "View{k}", "class"),
        (0, 1, None, "Doer{k}", "class"),
        (1, 0, None, "inner{k}", "function"),
        (1, 1, None, "top{k}", "function"),
        (1, 2, None, "open{k}", "function"),
    ],
    imports=[(2, 0, "Foundation", "module")],
)

TXT = Template(".txt", "plain text {k}\n")
EMPTY = Template(".py", "")
EMPTY_GO = Template(".go", "")

# the language of a part is its key modulo the number of these
LANGUAGES: dict[str, Template] = {
    "py": PY, "pybad": PYBAD, "js": JS, "jsx": JSX, "ts": TS, "tsx": TSX, "go": GO,
    "java": JAVA, "kt": KT, "cs": CS, "cpp": CPP, "c": C, "dart": DART, "proto": PROTO,
    "rb": RB, "rs": RS, "swift": SWIFT, "txt": TXT,
}
# files that come along with some of them
COMPANIONS: dict[str, Template] = {"helper": HELPER, "pystub": EMPTY, "gostub": EMPTY_GO}
TEMPLATES = {**LANGUAGES, **COMPANIONS}
JS_FAMILY = ("js", "jsx", "ts", "tsx")

KINDS = (
    "UserComponent", "HomeScreen", "AuthProvider", "apiRouter", "userService", "dataModel",
    "dbSchema", "unitTest", "fooSpec", "index", "mainEntry", "grpcClient", "util",
)
