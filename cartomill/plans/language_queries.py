"""Extraction in each language: a file for each part, whose names follow from the part's; SQL says what must come out.

The samples hold what misleads patterns: declarations in comments, strings, raw strings and heredocs, braces in regular
expressions and templates, several members on one line, and types in front of names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import extract as X
from ..functions import laravel
from ..functions.lineage import cut, spread
from ..registry import query
from ..sources.graph_tables import table
from .source_queries import filled, in_sql

PARTS = "WITH names AS (SELECT replace(p_name, ' ', '') || p_partkey AS k, upper(left(p_name, 1)) || substr(replace(p_name, ' ', ''), 2) || p_partkey AS c FROM part)"


def _names(s: SparkSession, d: str) -> DataFrame:
    """k, c of each part, spread: a text is long work."""
    k = F.replace("p_name", F.lit(" "), F.lit(""))
    return spread(table(s, d, "part").select(F.concat(k, F.col("p_partkey").cast("string")).alias("k"), F.concat(F.upper(F.substring(k, 1, 1)), F.expr("substr(replace(p_name, ' ', ''), 2)"), F.col("p_partkey").cast("string")).alias("c")))


def _files(s: SparkSession, d: str, path: str, text: str, language: str) -> DataFrame:
    return _names(s, d).select(filled(path).alias("path"), F.lit("r").alias("repo"), F.lit(language).alias("language"), filled(text).alias("text"))


#: language: extension, text, symbols (name, kind, scope, first and last line), references (name, kind, line).
SAMPLES = {
    "typescript": (".ts", """\
import a, { b } from './a';
import './side';
export * from "./c";
// new Ghost();
const s = "class Str { m() {} }";
export default class %C<T> extends Base<T> implements I, J.K {
  private readonly x: number = 1;
  static y?: { a: string };
  constructor(private svc: Service, b = new Map<string, number>()) { super(); }
  get v(): string { return `a ${this.run({a: 1})} }`; }
  async *gen<T>(a: T): Promise<{ z: number }> { const inner = () => { go(); }; yield inner(); } one() { return 1; }
  handler = (e) => { this.one(); };
  abstract nope(): void;
}
interface Shape extends Other { area(): number; name: string }
type Alias = { a: string } | null;
enum Color { Red, Green }
export const make = async (a: number): Promise<void> => { return /x{/.test(a) ? await load(a) : null; };
const two = x => x * 2;
function after() { return call2(); }
const El = () => <Widget a={f(1)}>don't<Sub.Part /></Widget>;
""",
        [('%C', 'class', None, 6, 14), ('x', 'property', '%C', 7, 7), ('y', 'property', '%C', 8, 8), ('constructor', 'method', '%C', 9, 9), ('v', 'method', '%C', 10, 10), ('gen', 'method', '%C', 11, 11), ('inner', 'function', '%C', 11, 11), ('one', 'method', '%C', 11, 11), ('handler', 'property', '%C', 12, 12), ('nope', 'method', '%C', 13, 13), ('Shape', 'interface', None, 15, 15), ('area', 'method', 'Shape', 15, 15), ('Alias', 'constant', None, 16, 16), ('Color', 'enum', None, 17, 17), ('make', 'function', None, 18, 18), ('two', 'function', None, 19, 19), ('after', 'function', None, 20, 20), ('El', 'function', None, 21, 21)],
        [('./a', 'import', 1), ('./side', 'import', 2), ('./c', 'import', 3), ('Base', 'extends', 6), ('I', 'implements', 6), ('J.K', 'implements', 6), ('run', 'call', 10), ('go', 'call', 11), ('inner', 'call', 11), ('one', 'call', 12), ('Other', 'extends', 15), ('test', 'call', 18), ('load', 'call', 18), ('call2', 'call', 20), ('Widget', 'render', 21), ('f', 'call', 21)]),
    "java": (".java", """\
package com.x.y;
import java.util.List;
import static a.b.C.d;
/* class Ghost {} */
@Entity(name = "x")
public final class %C<T extends Bar> extends Base implements A, B<C> {
    private static final int MAX = 3;
    private Map<String, List<Integer>> items = new HashMap<>();
    int a, b;
    enum Kind { ONE, TWO(2) { void x() {} }; int k() { return 1; } }
    public %C(int a) { this.a = a; helper("class X {"); }
    @Override public <R> List<R> run(List<R> in) throws IOException { return in.stream().map(x -> f(x)).toList(); }
    abstract void nothing();
    record Point(int x, int y) implements Z { }
}
interface Shape extends P, Q { double area(); default int z() { return 1; } }
@interface Mark { String value(); }
""",
        [('com.x.y', 'namespace', None, 1, 1), ('%C', 'class', None, 6, 15), ('MAX', 'constant', '%C', 7, 7), ('items', 'property', '%C', 8, 8), ('a', 'property', '%C', 9, 9), ('Kind', 'enum', '%C', 10, 10), ('ONE', 'constant', 'Kind', 10, 10), ('TWO', 'constant', 'Kind', 10, 10), ('k', 'method', 'Kind', 10, 10), ('%C', 'method', '%C', 11, 11), ('run', 'method', '%C', 12, 12), ('nothing', 'method', '%C', 13, 13), ('Point', 'class', '%C', 14, 14), ('Shape', 'interface', None, 16, 16), ('area', 'method', 'Shape', 16, 16), ('z', 'method', 'Shape', 16, 16), ('Mark', 'interface', None, 17, 17)],
        [('java.util.List', 'import', 2), ('a.b.C.d', 'import', 3), ('Entity', 'call', 5), ('Base', 'extends', 6), ('A', 'implements', 6), ('B', 'implements', 6), ('HashMap', 'instantiation', 8), ('x', 'call', 10), ('helper', 'call', 11), ('Override', 'call', 12), ('stream', 'call', 12), ('map', 'call', 12), ('f', 'call', 12), ('toList', 'call', 12), ('Z', 'implements', 14), ('P', 'extends', 16), ('Q', 'extends', 16), ('value', 'call', 17)]),
    "c-sharp": (".cs", """\
using System;
using Alias = A.B;
namespace X.Y {
  [Serializable]
  public class %C<T> : Base, IThing<T> where T : new() {
    private const int Max = 3;
    public string Name { get; set; } = "x";
    public int Twice => Max * 2;
    private readonly List<int> items = new List<int>();
    public event EventHandler Changed;
    public %C(int a) : base(a) { Init(); }
    public async Task<int> Run<TX>(string s) { return await Other(s); }
    public static bool operator ==(%C a, %C b) { return true; }
  }
  public delegate void Done(int code);
  enum E { A, B = 2 }
  record Point(int X, int Y) : Z;
  struct S { int q; }
}
""",
        [('X.Y', 'namespace', None, 3, 19), ('%C', 'class', None, 5, 14), ('Max', 'constant', '%C', 6, 6), ('Name', 'property', '%C', 7, 7), ('Twice', 'property', '%C', 8, 8), ('items', 'property', '%C', 9, 9), ('Changed', 'property', '%C', 10, 10), ('%C', 'method', '%C', 11, 11), ('Run', 'method', '%C', 12, 12), ('Done', 'interface', None, 15, 15), ('E', 'enum', None, 16, 16), ('A', 'constant', 'E', 16, 16), ('B', 'constant', 'E', 16, 16), ('Point', 'class', None, 17, 17), ('S', 'struct', None, 18, 18), ('q', 'property', 'S', 18, 18)],
        [('System', 'import', 1), ('A.B', 'import', 2), ('Serializable', 'call', 4), ('Base', 'extends', 5), ('IThing', 'extends', 5), ('List', 'instantiation', 9), ('Init', 'call', 11), ('Other', 'call', 12), ('Z', 'extends', 17)]),
    "go": (".go", """\
package main
import (
  "fmt"
  x "net/http"
)
const Max = 3
var ( a = 1; b = 2 )
type %C struct { A int; Bar }
type Shape interface {
  fmt.Stringer
  Area() float64
}
type Alias = []string
func (f *%C[T]) Run(a int) (int, error) { fmt.Println("func ghost() {"); y := %C{A: 1}; return help(a), nil }
func main() { if x := get(); x { } ; go run() }
""",
        [('main', 'namespace', None, 1, 1), ('Max', 'constant', None, 6, 6), ('a', 'property', None, 7, 7), ('b', 'property', None, 7, 7), ('%C', 'struct', None, 8, 8), ('Shape', 'interface', None, 9, 12), ('Alias', 'constant', None, 13, 13), ('Run', 'method', '%C', 14, 14), ('main', 'function', None, 15, 15)],
        [('fmt', 'import', 3), ('net/http', 'import', 4), ('fmt.Stringer', 'extends', 10), ('Println', 'call', 14), ('%C', 'instantiation', 14), ('help', 'call', 14), ('get', 'call', 15), ('run', 'call', 15)]),
    "rust": (".rs", """\
use std::collections::{HashMap, HashSet};
use crate::a::b;
pub struct %C<'a, T> { x: &'a T }
pub trait Shape { fn area(&self) -> f64; }
impl<'a, T: Clone> Shape for %C<'a, T> { fn area(&self) -> f64 { println!("}}"); self.x.go() } }
impl %C<'_, i32> { pub async fn new() -> Self { let f = %C { x: &1 }; Self::make(1) } }
enum Kind { One, Two(i32), Three { a: u8 } }
mod inner { pub const MAX: usize = 3; fn deep() { helper::<i32>(1); } }
macro_rules! mac { ($a:expr) => { fn ghost() {} } }
type A = Vec<u8>;
static S: &str = "x";
""",
        [('%C', 'struct', None, 3, 3), ('Shape', 'interface', None, 4, 4), ('area', 'method', 'Shape', 4, 4), ('%C', 'class', None, 5, 5), ('area', 'method', '%C', 5, 5), ('%C', 'class', None, 6, 6), ('new', 'method', '%C', 6, 6), ('Kind', 'enum', None, 7, 7), ('One', 'constant', 'Kind', 7, 7), ('Two', 'constant', 'Kind', 7, 7), ('Three', 'constant', 'Kind', 7, 7), ('inner', 'module', None, 8, 8), ('MAX', 'constant', 'inner', 8, 8), ('deep', 'function', 'inner', 8, 8), ('mac', 'function', None, 9, 9), ('A', 'constant', None, 10, 10), ('S', 'constant', None, 11, 11)],
        [('std::collections', 'import', 1), ('crate::a::b', 'import', 2), ('Shape', 'implements', 5), ('println', 'call', 5), ('go', 'call', 5), ('%C', 'instantiation', 6), ('make', 'call', 6), ('helper', 'call', 8)]),
    "kotlin": (".kt", """\
package a.b
import x.y.Z
class %C(val a: Int) : Base(a), Iface<String> {
  val name = "class X {"
  var other: Int = 3
    get() = field
  fun run(x: Int): Int = help(x)
  fun <T> String.ext(): T { items.map { it.go() }; return make() }
  companion object { fun create() = %C(1) }
}
object Single { fun s() {} }
interface Shape { fun area(): Double }
enum class Kind { ONE, TWO }
fun top() { println("hi") }
typealias A = List<String>
""",
        [('%C', 'class', None, 3, 10), ('name', 'property', '%C', 4, 4), ('other', 'property', '%C', 5, 5), ('run', 'method', '%C', 7, 7), ('ext', 'method', '%C', 8, 8), ('create', 'method', '%C', 9, 9), ('Single', 'class', None, 11, 11), ('s', 'method', 'Single', 11, 11), ('Shape', 'interface', None, 12, 12), ('area', 'method', 'Shape', 12, 12), ('Kind', 'enum', None, 13, 13), ('ONE', 'constant', 'Kind', 13, 13), ('TWO', 'constant', 'Kind', 13, 13), ('top', 'function', None, 14, 14), ('A', 'constant', None, 15, 15)],
        [('x.y.Z', 'import', 2), ('Base', 'extends', 3), ('Base', 'instantiation', 3), ('Iface', 'implements', 3), ('help', 'call', 7), ('map', 'call', 8), ('go', 'call', 8), ('make', 'call', 8), ('%C', 'instantiation', 9), ('println', 'call', 14)]),
    "swift": (".swift", """\
import UIKit
class %C<T>: Base, Proto {
  let x = 1
  var y: Int { return z() }
  init(a: Int) { super.init() }
  func run(_ a: Int) -> Int { return Helper(a).go() }
}
protocol P { func f() }
extension %C: Q { func ext() {} }
enum E { case a, b }
struct S {}
func top() { /* { /* */ } */ call() }
""",
        [('%C', 'class', None, 2, 7), ('x', 'property', '%C', 3, 3), ('y', 'property', '%C', 4, 4), ('init', 'method', '%C', 5, 5), ('run', 'method', '%C', 6, 6), ('P', 'interface', None, 8, 8), ('f', 'method', 'P', 8, 8), ('%C', 'class', None, 9, 9), ('ext', 'method', '%C', 9, 9), ('E', 'enum', None, 10, 10), ('S', 'struct', None, 11, 11), ('top', 'function', None, 12, 12)],
        [('UIKit', 'import', 1), ('Base', 'extends', 2), ('Proto', 'extends', 2), ('z', 'call', 4), ('init', 'call', 5), ('Helper', 'instantiation', 6), ('go', 'call', 6), ('Q', 'extends', 9), ('call', 'call', 12)]),
    "scala": (".scala", """\
package a.b
import x.{Y, Z}
trait T extends U with V { def f(x: Int): Int }
object O { val Max = 3; var q = 1; def g() = { h(1); new %C(2) } }
case class P(x: Int) extends Base(x) with W
type A = Int
""",
        [('a.b', 'namespace', None, 1, 1), ('T', 'interface', None, 3, 3), ('f', 'method', 'T', 3, 3), ('O', 'class', None, 4, 4), ('Max', 'constant', 'O', 4, 4), ('q', 'property', 'O', 4, 4), ('g', 'method', 'O', 4, 4), ('P', 'class', None, 5, 5), ('A', 'constant', None, 6, 6)],
        [('x.Y', 'import', 2), ('x.Z', 'import', 2), ('U', 'extends', 3), ('V', 'extends', 3), ('h', 'call', 4), ('%C', 'instantiation', 4), ('Base', 'extends', 5), ('Base', 'call', 5), ('W', 'extends', 5)]),
    "dart": (".dart", """\
import 'package:a/b.dart';
const kMax = 3;
final name = 'x';
class %C extends Base with Mix implements I {
  final int a;
  %C(this.a) : super(1) { init(); }
  int get v => 1;
  Future<void> run(int x) async { await helper(x); Widget(1); }
}
mixin Mix on Base { void m() {} }
extension Ext on String { int len() => length2(); }
enum E { a, b }
void main() { run(); }
int twice(int x) => dbl(x);
""",
        [('kMax', 'constant', None, 2, 2), ('name', 'constant', None, 3, 3), ('%C', 'class', None, 4, 9), ('%C', 'method', '%C', 6, 6), ('run', 'method', '%C', 8, 8), ('Mix', 'trait', None, 10, 10), ('m', 'method', 'Mix', 10, 10), ('Ext', 'class', None, 11, 11), ('len', 'method', 'Ext', 11, 11), ('E', 'enum', None, 12, 12), ('main', 'function', None, 13, 13), ('twice', 'function', None, 14, 14)],
        [('package:a/b.dart', 'import', 1), ('Base', 'extends', 4), ('Mix', 'extends', 4), ('I', 'implements', 4), ('init', 'call', 6), ('helper', 'call', 8), ('Widget', 'instantiation', 8), ('length2', 'call', 11), ('run', 'call', 13), ('dbl', 'call', 14)]),
    "c": (".c", """\
#include <stdio.h>
#include "a.h"
#define MAX 3
#define SQ(x) \\
  ((x) * foo(x))
struct P { int x; };
typedef struct { int a; } T;
typedef int (*cb)(int);
enum E { A, B };
static int helper(int a);
static int helper(int a) { return a ? call("}") : p->go(a); }
int main(void)
{
  struct P q = {1};
  return helper(1);
}
""",
        [('MAX', 'constant', None, 3, 3), ('SQ', 'constant', None, 4, 4), ('P', 'struct', None, 6, 6), ('T', 'constant', None, 7, 7), ('cb', 'constant', None, 8, 8), ('E', 'enum', None, 9, 9), ('helper', 'function', None, 11, 11), ('main', 'function', None, 12, 16)],
        [('stdio.h', 'import', 1), ('a.h', 'import', 2), ('call', 'call', 11), ('go', 'call', 11), ('helper', 'call', 15)]),
    "cpp": (".cpp", """\
#include <vector>
namespace ns {
template <typename T>
class %C : public Base<T>, private B2 {
 public:
  %C(int a) : x_(a), y_{1} { init(); }
  ~%C() {}
  virtual int run(int a) const override { return std::max(a, 1); }
  int decl(int);
 private:
  int x_;
};
int %C::other(int a) { auto p = new Bar(1); return p->go(); }
}
using A = int;
enum class E { X };
auto f() -> int { return g<int>(1); }
""",
        [('ns', 'namespace', None, 2, 14), ('%C', 'class', None, 4, 12), ('%C', 'function', '%C', 6, 6), ('~%C', 'function', '%C', 7, 7), ('run', 'function', '%C', 8, 8), ('other', 'function', '%C', 13, 13), ('A', 'constant', None, 15, 15), ('E', 'enum', None, 16, 16), ('f', 'function', None, 17, 17)],
        [('vector', 'import', 1), ('Base', 'extends', 4), ('B2', 'extends', 4), ('init', 'call', 6), ('max', 'call', 8), ('Bar', 'instantiation', 13), ('go', 'call', 13), ('g', 'call', 17)]),
    "zig": (".zig", """\
const std = @import("std");
pub const %C = struct {
  x: u8,
  pub fn init(a: u8) %C { return helper(a); }
};
const Err = error{ Bad };
pub fn main() !void { std.debug.print("}", .{}); }
test "adds" { try run(); }
""",
        [('std', 'constant', None, 1, 1), ('%C', 'struct', None, 2, 5), ('init', 'method', '%C', 4, 4), ('Err', 'enum', None, 6, 6), ('main', 'function', None, 7, 7), ('adds', 'function', None, 8, 8)],
        [('std', 'import', 1), ('helper', 'call', 4), ('print', 'call', 7), ('run', 'call', 8)]),
    "ruby": (".rb", """\
require 'json'
module Shop
  class Order < Base::Record
    include Comparable
    MAX = 3
    attr_reader :id, :total
    # class Ghost
    def initialize(id) = @id = id
    def run(x)
      if x then y end
      return 1 if x > 2
      items.each do |i|
        puts "end #{i}"
      end
      while x do x -= 1 end
      Helper.new(x).go(1)
    end
    def self.make; end
  end
end
def top
  call(1)
end
""",
        [('Shop', 'module', None, 2, 20), ('Order', 'class', 'Shop', 3, 19), ('MAX', 'constant', 'Order', 5, 5), ('total', 'property', 'Order', 6, 6), ('id', 'property', 'Order', 6, 6), ('initialize', 'method', 'Order', 8, 8), ('run', 'method', 'Order', 9, 17), ('make', 'method', 'Order', 18, 18), ('top', 'function', None, 21, 23)],
        [('json', 'require', 1), ('Base::Record', 'extends', 3), ('Comparable', 'extends', 4), ('each', 'call', 12), ('Helper', 'instantiation', 16), ('go', 'call', 16), ('call', 'call', 22)]),
    "lua": (".lua", """\
local json = require("json")
-- function ghost() end
local M = {}
function M.add(a) if a then return help(a) end end
function M:meth() for i = 1, 2 do print(i) end end
local function priv() return [[ end ]] end
f = function() g() end
""",
        [('json', 'constant', None, 1, 1), ('M', 'constant', None, 3, 3), ('add', 'function', 'M', 4, 4), ('meth', 'method', 'M', 5, 5), ('priv', 'function', None, 6, 6), ('f', 'function', None, 7, 7)],
        [('json', 'require', 1), ('help', 'call', 4), ('print', 'call', 5), ('g', 'call', 7)]),
    "elixir": (".ex", """\
defmodule Shop.Order do
  @moduledoc \"\"\"
  defmodule Ghost do
  \"\"\"
  use GenServer
  alias Shop.{Item, User}
  @max 3
  defstruct [:id]
  def run(x) do
    x |> help() |> Enum.map(fn y -> go(y) end)
  end
  defp short(x), do: x
  def two(x) when x > 1, do: call(x)
end
defimpl Proto, for: Shop.Order do
  def f(x), do: g(x)
end
""",
        [('Shop.Order', 'module', None, 1, 14), ('max', 'constant', 'Shop.Order', 7, 7), ('Order', 'struct', 'Shop.Order', 8, 8), ('run', 'function', 'Shop.Order', 9, 11), ('short', 'function', 'Shop.Order', 12, 12), ('two', 'function', 'Shop.Order', 13, 13), ('f', 'function', None, 16, 16)],
        [('GenServer', 'extends', 5), ('Shop.Item', 'import', 6), ('Shop.User', 'import', 6), ('help', 'call', 10), ('map', 'call', 10), ('go', 'call', 10), ('call', 'call', 13), ('Proto', 'implements', 15), ('g', 'call', 16)]),
    "bash": (".sh", """\
#!/bin/bash
source ./lib.sh
NAME="x # y"
run() {
  local a=1
  echo "function ghost() {"
  helper "$a" | other
}
function two { run; }
cat <<EOF
function ghost2() { }
EOF
alias ll='ls -l'
run
""",
        [('NAME', 'constant', None, 3, 3), ('run', 'function', None, 4, 8), ('a', 'constant', None, 5, 5), ('two', 'function', None, 9, 9), ('ll', 'constant', None, 13, 13)],
        [('./lib.sh', 'import', 2), ('echo', 'call', 6), ('helper', 'call', 7), ('other', 'call', 7), ('run', 'call', 9), ('cat', 'call', 10), ('run', 'call', 14)]),
    "pascal": (".pas", """\
unit Shop;
interface
uses SysUtils, System.Classes;
type
  TKind = (one, two);
  TOrder = class(TBase, IOrder)
  private
    FId: Integer;
  public
    constructor Create(Id: Integer);
    function Total: Double;
  end;
  TRec = record
    X: Integer;
  end;
const
  Max = 3;
var
  Glob: Integer;
implementation
{ procedure Ghost; begin end; }
constructor TOrder.Create(Id: Integer);
begin
  FId := Id;
end;
function TOrder.Total: Double;
begin
  if FId > 1 then begin Helper(FId); end;
  Result := Calc(FId);
end;
procedure Top;
begin
  Glob := TOrder.Create(1);
end;
end.
""",
        [('Shop', 'module', None, 1, 35), ('TKind', 'enum', None, 5, 5), ('TOrder', 'class', None, 6, 12), ('FId', 'constant', 'TOrder', 8, 8), ('Create', 'method', 'TOrder', 10, 10), ('Total', 'method', 'TOrder', 11, 11), ('TRec', 'struct', None, 13, 15), ('X', 'constant', 'TRec', 14, 14), ('Max', 'constant', None, 17, 17), ('Glob', 'property', None, 19, 19), ('Create', 'method', 'TOrder', 22, 25), ('Total', 'method', 'TOrder', 26, 30), ('Top', 'function', None, 31, 34)],
        [('SysUtils', 'import', 3), ('System.Classes', 'import', 3), ('TBase', 'extends', 6), ('IOrder', 'implements', 6), ('Helper', 'call', 28), ('Calc', 'call', 29), ('TOrder', 'instantiation', 33)]),
    "javascript": (".js", """\
import %C, { bar } from './%k';
const lazy = require("../lazy");
/* class Ghost { run() {} } // */
class %C extends Base {
  #secret = 1;
  static make(a, { b } = {}) { return new %C(a / b / 2); } get size() { return this.list.length; }
  *items() { yield* this.other(`${[1, 2].map((x) => `<${x}>`)} }`); }
}
const go = function () { return /[/}]/g.exec("}") && start(); };
let arrow = async () => {
  await Promise.all([load()]);
};
export function last() { if (a) { b(); } else { return c(d); } }
""",
        [('%C', 'class', None, 4, 8), ('make', 'method', '%C', 6, 6), ('size', 'method', '%C', 6, 6), ('items', 'method', '%C', 7, 7), ('go', 'function', None, 9, 9), ('arrow', 'function', None, 10, 12), ('last', 'function', None, 13, 13)],
        [('./%k', 'import', 1), ('../lazy', 'require', 2), ('Base', 'extends', 4), ('%C', 'instantiation', 6), ('other', 'call', 7), ('map', 'call', 7), ('exec', 'call', 9), ('start', 'call', 9), ('all', 'call', 11), ('load', 'call', 11), ('b', 'call', 13), ('c', 'call', 13)]),
    "tsx": (".tsx", """\
import React from 'react';
type Props = { title: string };
export const %C: React.FC<Props> = ({ title }) => {
  const [open, setOpen] = useState<boolean>(false);
  return <Layout title={title}><Header.Title on={() => setOpen(!open)} />{open ? <p>It&apos;s</p> : null}</Layout>;
};
export default class Page extends React.Component<Props> {
  state: { a: number } = { a: 1 };
  render() { return <%C title="class Ghost {" />; }
}
""",
        [('Props', 'constant', None, 2, 2), ('%C', 'function', None, 3, 6), ('Page', 'class', None, 7, 10), ('state', 'property', 'Page', 8, 8), ('render', 'method', 'Page', 9, 9)],
        [('react', 'import', 1), ('useState', 'call', 4), ('Layout', 'render', 5), ('Header.Title', 'render', 5), ('setOpen', 'call', 5), ('React.Component', 'extends', 7), ('%C', 'render', 9)]),
    "svelte": (".svelte", """\
<script>
import %C from './%k.svelte';
// function ghost() {}
export function use%C(x) { return helper(x); }
</script>
<p class="x">{use%C(1)}</p>
<script context="module">
const two = (a) => a * 2;
</script>
""",
        [('use%C', 'function', None, 4, 4), ('two', 'function', None, 8, 8)],
        [('./%k.svelte', 'import', 2), ('helper', 'call', 4)]),
}


def _rows(language: str) -> None:
    extension, text, symbols, references = SAMPLES[language]
    rows = [("symbol", *s) for s in symbols] + [("reference", name, kind, None, line, None) for name, kind, line in references]
    value = lambda v: "CAST(NULL AS INTEGER)" if v is None else str(v)
    one = [f"SELECT {in_sql('src/%k' + extension)} AS path, '{row}' AS row, {in_sql(name)} AS name, '{kind}' AS kind, {in_sql(scope)} AS scope, {value(a)} AS start_line, {value(b)} AS end_line FROM names" for row, name, kind, scope, a, b in rows]
    query(f"extract_{language.replace('-', '_')}_rows", f"{PARTS} {' UNION ALL '.join(one)}", lambda s, d: X.extract(_files(s, d, f"src/%k{extension}", text, language)).select("path", "row", "name", "kind", "scope", "start_line", "end_line"))


for _language in SAMPLES:
    _rows(_language)

# --- PHP: types of variables, and what a framework means

PHP_FLOW = """<?php
namespace App\\Http;
use App\\Models\\User;
use App\\Services\\{Billing, Mail\\Sender as Post};
use Illuminate\\Support\\Facades\\Cache;
class %C extends Controller {
    private ?Billing $billing;
    /** @var Post */
    private $post;
    public function __construct(private readonly Gateway $gateway, int|string $n = 1) { $this->log = new Logger(); }
    public function show(User $user, ?Order $order): Invoice {
        $user->orders(); $this->billing->charge($user); $this->gateway->send(); // $user->ghost();
        $this->post->mail(); $this->log->info('$user->ghost()');
        $svc = new Svc(1); $copy = $svc; $copy->again(); $svc = compute(); $svc->unknown();
        self::make(); parent::boot(); Cache::get('k');
        /** @var Report $report */
        $report = load(); $report->build();
        $fn = function (Item $i) use ($order) { $i->x(); $order->y(); $user->none(); };
        dispatch(new Ship($order)); event(new Shipped()); Letter::dispatchSync($user);
        $user->notify(new Paid());
        return $this->hasMany(Item::class);
    }
}
class Provider%C extends ServiceProvider {
    public function boot() {
        $this->app->bind(Contract::class, Concrete::class);
        $this->app->when(A::class)->needs(B::class)->give(C::class);
    }
}
"""
_H, _M, _S = "App\\Http\\", "App\\Models\\", "App\\Services\\"
PHP_CALLS = [
    (_M + "User::orders", 12), (_S + "Billing::charge", 12), (_H + "Gateway::send", 12), (_S + "Mail\\Sender::mail", 13), (_H + "Logger::info", 13), (_H + "Svc::again", 14), ("compute", 14), ("unknown", 14),
    (_H + "%C::make", 15), (_H + "Controller::boot", 15), ("Illuminate\\Cache\\CacheManager::get", 15), ("load", 17), (_H + "Report::build", 17), (_H + "Item::x", 18), (_H + "Order::y", 18), ("none", 18), ("dispatch", 19), ("event", 19), (_M + "User::notify", 20),
    ("bind", 26), ("when", 27), ("needs", 27), ("give", 27),
]
PHP_MEANT = [
    (_H + "Ship", "dispatch", "show", "dispatch: job"), (_H + "Shipped", "dispatch", "show", "event: event"), (_H + "Letter", "dispatch", "show", "dispatchSync: job"), (_H + "Paid", "notify", "show", "notify"), (_H + "Item", "relation", "%C", "hasMany: one-to-many"),
    (_H + "Contract", "binding", "boot", f"bind: {_H}Concrete: boot"), (_H + "B", "binding", "boot", f"when {_H}A: {_H}C: boot"),
]
PHP_HINTS = [(_S + "Billing", "param_type", "%C"), (_H + "Gateway", "param_type", "__construct"), (_M + "User", "param_type", "show"), (_H + "Order", "param_type", "show"), (_H + "Invoice", "return_type", "show"), (_H + "Item", "param_type", "show")]


def _php(s: SparkSession, d: str) -> DataFrame:
    return X.extract(_files(s, d, "app/Http/%k.php", PHP_FLOW, "php"))


def _rows_sql(columns: str, rows: list[tuple]) -> str:
    return f"{PARTS} " + " UNION ALL ".join("SELECT " + ", ".join(f"{in_sql(v) if isinstance(v, str) else v} AS {c}" for c, v in zip(columns.split(), row)) + " FROM names" for row in rows)


query("php_calls", _rows_sql("name line", PHP_CALLS), lambda s, d: X.references_of(_php(s, d)).where("edge_type = 'call'").select(F.col("symbol").alias("name"), "line"))
query("php_framework_edges", _rows_sql("name kind source detail", PHP_MEANT), lambda s, d: _php(s, d).where("row = 'reference' AND kind IN ('dispatch', 'notify', 'relation', 'binding')").select("name", "kind", F.col("scope").alias("source"), F.col("signature").alias("detail")))
query("php_type_hints", _rows_sql("name kind source", PHP_HINTS), lambda s, d: _php(s, d).where("row = 'reference' AND kind IN ('param_type', 'return_type')").select("name", "kind", F.col("scope").alias("source")))
query("php_roles", _rows_sql("path name role", [("app/Http/%k.php", "%C", "model"), ("app/Http/%k.php", "Provider%C", "service_provider")]), lambda s, d: X.roles_of(_php(s, d)))

# --- Laravel: facts of single files, joined. Each part is a project of its own

LARAVEL = {
    "app/Http/Kernel.php": "<?php\nnamespace App\\Http;\nuse App\\Http\\Middleware\\{Auth%C, Log%C};\nclass Kernel extends HttpKernel {\n    // protected $middlewareAliases = ['ghost' => Ghost::class];\n    protected $middlewareAliases = ['auth' => Auth%C::class, 'log' => Log%C::class];\n    protected $middlewareGroups = [\n        'web' => [Middleware\\Csrf%C::class, 'log'],\n        'full' => ['web', 'auth:api'],\n    ];\n}\n",
    "app/Http/Middleware/Auth%C.php": "<?php\nnamespace App\\Http\\Middleware;\nclass Auth%C { public function handle($r, $next) {} }\n",
    "app/Http/Middleware/Log%C.php": "<?php\nnamespace App\\Http\\Middleware;\nclass Log%C {}\n",
    "app/Http/Middleware/Csrf%C.php": "<?php\nnamespace App\\Http\\Middleware;\nclass Csrf%C {}\n",
    "app/Providers/RouteServiceProvider.php": "<?php\nnamespace App\\Providers;\nclass RouteServiceProvider extends ServiceProvider {\n    public function boot() {\n        Route::prefix('api/%k')->middleware('web')->group(base_path('routes/api.php'));\n    }\n}\n",
    "routes/web.php": "<?php\nRoute::middleware(['full'])->group(function () {\n    Route::get('/x', [XController::class, 'x'])->middleware('log');\n});\n",
    "routes/api.php": "<?php\nRoute::get('/y', [YController::class, 'y']);\n",
    "app/Providers/AppServiceProvider.php": "<?php\nnamespace App\\Providers;\nuse App\\Pay\\{Gateway, Stripe%C};\nclass AppServiceProvider extends ServiceProvider {\n    public function register() {\n        $this->app->bind(Gateway::class, Stripe%C::class);\n    }\n}\n",
    "app/Pay/Gateway.php": "<?php\nnamespace App\\Pay;\ninterface Gateway {}\n",
    "app/Pay/Stripe%C.php": "<?php\nnamespace App\\Pay;\nclass Stripe%C implements Gateway {}\n",
    "app/Providers/EventServiceProvider.php": "<?php\nnamespace App\\Providers;\nuse App\\Events\\Paid%C;\nuse App\\Listeners\\Mail%C;\nclass EventServiceProvider extends ServiceProvider {\n    protected $listen = [Paid%C::class => [Mail%C::class]];\n}\n",
    "app/Events/Paid%C.php": "<?php\nnamespace App\\Events;\nclass Paid%C {}\n",
    "app/Listeners/Mail%C.php": "<?php\nnamespace App\\Listeners;\nclass Mail%C {}\n",
    "app/Listeners/Found%C.php": "<?php\nnamespace App\\Listeners;\nuse App\\Events\\Paid%C;\nclass Found%C { public function handle(Paid%C $e) {} }\n",
    "app/Jobs/Ship%C.php": "<?php\nnamespace App\\Jobs;\nclass Ship%C implements ShouldQueue {}\n",
    "app/Http/PayController.php": "<?php\nnamespace App\\Http;\nuse App\\Events\\Paid%C;\nuse App\\Jobs\\Ship%C;\nclass PayController extends Controller {\n    public function __construct() { $this->middleware('auth'); }\n    public function pay() {\n        event(new Paid%C());\n        Ship%C::dispatch();\n    }\n}\n",
}
_MW, _PAY = "app/Http/Middleware/", "app/Http/PayController.php"
LARAVEL_EDGES = [
    ("routes/web.php", _MW + "Csrf%C.php", "Csrf%C", "middleware", "full"), ("routes/web.php", _MW + "Log%C.php", "Log%C", "middleware", "full"), ("routes/web.php", _MW + "Auth%C.php", "Auth%C", "middleware", "full"), ("routes/web.php", _MW + "Log%C.php", "Log%C", "middleware", "log"),
    ("routes/api.php", _MW + "Csrf%C.php", "Csrf%C", "middleware", "web"), ("routes/api.php", _MW + "Log%C.php", "Log%C", "middleware", "web"), (_PAY, _MW + "Auth%C.php", "Auth%C", "middleware", "auth"),
    ("app/Providers/AppServiceProvider.php", "app/Pay/Stripe%C.php", "Stripe%C", "binding", "bind"), ("app/Pay/Gateway.php", "app/Pay/Stripe%C.php", "Stripe%C", "binding", "bind"),
    (_PAY, "app/Events/Paid%C.php", "Paid%C", "dispatch", "event"), (_PAY, "app/Jobs/Ship%C.php", "Ship%C", "dispatch", "job"), (_PAY, "app/Listeners/Mail%C.php", "Mail%C", "hook", "Paid%C"), (_PAY, "app/Listeners/Found%C.php", "Found%C", "hook", "Paid%C"),
]


def _laravel_files(s: SparkSession, d: str) -> DataFrame:
    files = F.explode(F.array(*(F.struct(filled(path).alias("path"), filled(text).alias("text")) for path, text in LARAVEL.items())))
    return _names(s, d).select(F.col("k").alias("repo"), files.alias("f")).select("repo", "f.path", "f.text")


def _laravel(s: SparkSession, d: str) -> DataFrame:
    return cut(laravel.facts(_laravel_files(s, d)))


query("laravel_edges", _rows_sql("repo source_file target_file target_symbol edge_type detail", [("%k", *row) for row in LARAVEL_EDGES]), lambda s, d: laravel.edges(_laravel(s, d)).select("repo", "source_file", "target_file", "target_symbol", "edge_type", "detail"))
query("laravel_route_files", _rows_sql("repo route_file prefix middleware", [("%k", "routes/api.php", "/api/%k", "web")]), lambda s, d: laravel.route_prefixes(_laravel(s, d)))
query("laravel_middleware", _rows_sql("repo name class", [("%k", name, "App\\Http\\Middleware\\" + c) for name, c in (("auth", "Auth%C"), ("log", "Log%C"), ("web", "Csrf%C"), ("web", "Log%C"), ("full", "Csrf%C"), ("full", "Log%C"), ("full", "Auth%C"))]), lambda s, d: laravel.middleware_classes(_laravel(s, d)))
